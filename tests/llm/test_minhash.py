from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD_TEXTS, SF, documents, near_groups, texts_of
from wrenchline.llm import graph, minhash
from wrenchline.llm.minhash import expected_mismatches, minima, mismatches, near_duplicates, packed, shingle_hashes
from wrenchline.llm.queries import QUERIES
from wrenchline.llm.textbytes import chunks


def check(found, texts):
    sizes, comps = near_groups(texts)
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], comps[r["doc_id"]]), r
        assert r["kept"] == (r["doc_id"] == comps[r["doc_id"]])


def test_query_against_all_pairs(spark):
    found = QUERIES["op8_bbit_minhash"](spark, SF)
    check(found, texts_of(spark.read.parquet(f"{SF}/documents.parquet")))


def test_odd_texts_and_other_columns(spark):
    docs = documents(spark, ODD_TEXTS)
    clash = docs.withColumns({c: F.lit(1) for c in ("key", "size", "comp", "first", "sig", "component_id", "kept")})
    check(near_duplicates(clash), texts_of(docs))
    assert near_duplicates(docs.limit(0)).count() == 0


def group_of_edits(n: int, words: int, edits: int) -> list[str]:
    random.seed(3)
    base = [f"w{random.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in random.sample(range(words), random.randint(0, edits)):
            own[k] = f"x{random.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("task_links", [0, 1000])
def test_a_large_group_of_near_copies_in_small_tiles(spark, monkeypatch, task_links):
    """Many pairs near the threshold, buckets of several tiles, several rounds, both ways to finish components."""
    monkeypatch.setattr(minhash, "components", lambda links: graph.components(links, task_links))
    texts = group_of_edits(250, 120, 5) + group_of_edits(40, 60, 6) + ["alone in the world is this text " + str(i) for i in range(9)]
    docs = documents(spark, texts)
    check(near_duplicates(docs, tile_rows=70), texts_of(docs))


def test_components_of_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (95, 100), (7, 7), (200, 150), (200, 150)]
    df = spark.createDataFrame(links, "a long, b long")
    for task_links in (0, 10**6):
        got = {r["node"]: r["comp"] for r in graph.components(df, task_links).collect()}
        assert got == {**{i: 0 for i in range(1, 61)}, 95: 90, 100: 90, 200: 150}
    assert graph.components(df.limit(0)).count() == 0


def test_bit_counts_estimate_similarity():
    import pyarrow as pa
    a, b = (" ".join(f"w{i}" for i in range(lo, lo + 2000)) for lo in (0, 300))
    (chunk,) = chunks(pa.array([a, b]))
    hashes, firsts = shingle_hashes(chunk)
    sig = packed(minima(hashes, firsts))
    apart = int(mismatches(sig[0], sig[1]))
    x, y = (set(hashes[firsts[i]:firsts[i + 1]].tolist()) for i in (0, 1))
    true = len(x & y) / len(x | y)
    assert abs(apart - expected_mismatches(true)) <= 4 * np.sqrt(128 * 0.2 * 0.8)
    assert mismatches(sig[0], sig[0]) == 0
