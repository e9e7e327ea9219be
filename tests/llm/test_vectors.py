from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SF, union_of
from wrenchline.llm.pivots import near_vectors, pivots_for
from wrenchline.llm.queries import QUERIES


def check(found, rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = set()
    for k, (i, v, lab) in enumerate(good):
        for j, w, other in good[:k]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.add((i, j))
    comps = union_of(links, [r[0] for r in rows])
    degree = {r[0]: sum(r[0] in link for link in links) for r in rows}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (
            degree[r["vec_id"]], comps[r["vec_id"]], comps[r["vec_id"]] == r["vec_id"]), r


def test_query_against_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op4_pivot_permutations"](spark, SF), rows)


@pytest.mark.parametrize("tile_rows", [1024, 9])
def test_groups_copies_and_unsound_vectors(spark, tile_rows):
    random = np.random.default_rng(4)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(12):
            base = random.normal(size=16)
            for _ in range(random.integers(1, 9)):
                rows.append((i, (base + random.normal(size=16) * 0.05).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 1) for k in range(5)]
    rows += [(i + 5 + k, v, lab) for k, (v, lab) in enumerate([
        (None, 1), ([], 1), ([0.0] * 16, 1), ([None] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] * 16, 1),
        (rows[0][1], None), (rows[0][1][:8], 1), ([1e-30] * 16, 2), ([1e30] * 16, 2)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {c: F.lit(0) for c in ("key", "size", "code", "copies", "first", "n_links")})
    check(near_vectors(df, tile_rows=tile_rows), rows)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [3, 2])
def test_group_of_near_copies_that_is_a_large_part(spark, share):
    random = np.random.default_rng(8)
    base = random.normal(size=16)
    rows = [(i, (base + random.normal(size=16) * 0.11 if i % share == 0 else random.normal(size=16)).tolist(), 1)
            for i in range(660)]
    check(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), rows)


def test_repeated_rows_and_null_ids(spark):
    """Rows are vectors of their own; brute force by row number, ids only name the components."""
    random = np.random.default_rng(6)
    near = random.normal(size=16)
    rows = [(7, [1.0, 2.0], 1)] * 3 + [(7, [5.0, 1.0], 1), (8, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (9, None, 1),
                                       (9, None, 1), (None, [0.0, 0.0], 1), (None, [3.0, -1.0], 2), (None, [3.0, -1.0], 2)]
    for k in range(40):
        v = (near + random.normal(size=16) * 0.08).tolist()
        rows += [(100 + k // 2 if k % 7 else None, v, 3)] * (1 + k % 3)
    sound = [k for k, (_, v, _) in enumerate(rows) if v and any(v)]
    links = {(j, k) for k in sound for j in sound if j < k and rows[j][2] == rows[k][2] and len(rows[j][1]) == len(rows[k][1])
             and np.dot(rows[j][1], rows[k][1]) / np.linalg.norm(rows[j][1]) / np.linalg.norm(rows[k][1]) >= 0.98}
    comps = union_of(links, range(len(rows)))
    want = []
    for k, (i, _, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if comps[j] == comps[k] and rows[j][0] is not None), default=None)
        want.append((i, sum(k in link for link in links), least, i == least))
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_pivots_grow_with_the_table():
    """Entries of a list, on average, stay within the same bound at any size up to that of the most pivots."""
    assert pivots_for(0) == pivots_for(200_000) == 128 and pivots_for(1 << 40) == 2048
    assert all(8 * n / pivots_for(n) <= 8 * 4096 for n in (200_000, 800_000, 2_000_000, 8_000_000))
