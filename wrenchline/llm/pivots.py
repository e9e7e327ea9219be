"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are drawn by hash from the data, none of them close to another, so that a large group of near
copies has one pivot and its members rank the same pivots, not arbitrary ones among themselves. A vector is described by
its ``NEAREST`` nearest pivots and entered into the inverted lists of the first ``POSTED`` of them, in one order that is
common to all vectors. Within a list, pairs are retrieved by the number of nearest pivots they share and only these are
verified by cosine in double precision. A pair is handled in the list of the first pivot under which both are entered.

Equal vectors form a class, of which one goes on. Lists are compared in tiles of a bounded number of vectors, which
return the number of links of each vector and a spanning forest of the links, never all pairs. The pivots grow with the
table, so that lists stay short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.graph import components, union_find
from wrenchline.llm.minhash import in_tiles, tiles_of
from wrenchline.llm.textbytes import U64
from wrenchline.session import pinned

THRESHOLD = 0.98
#: Pivots for a table of ``rows``: at least the first number, one for so many rows, at most the last.
PIVOTS, ROWS_PER_PIVOT, MOST_PIVOTS = 128, 4096, 2048
#: Candidates for each pivot; a pivot has a cosine below ``APART`` to the others.
CANDIDATES = 16
APART = 0.9
NEAREST = 12
POSTED = 8
#: Pairs that share fewer of their nearest pivots are not compared.
SHARED = 3
TILE_ROWS = 1024
#: Pairs whose cosine is computed at once, when few of a tile are candidates.
PAIRS = 16_384


def is_sound() -> Column:
    """Whether a row may link: label and vector not null, all components finite, not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(
        "embedding", lambda x: x != 0)
    return F.coalesce(whole, F.lit(False))


def pivots_for(rows: int) -> int:
    """Number of pivots, a multiple of 64 as masks are made of 64-bit words."""
    return min(MOST_PIVOTS, max(PIVOTS, -(-rows // (ROWS_PER_PIVOT * 64)) * 64))


def units(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all vectors of the column have the same size."""
    rows = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


def _masks(top: np.ndarray, words: int) -> pa.Array:
    """Sets of pivot numbers as bits."""
    masks = np.zeros((len(top), words), U64)
    for k in range(top.shape[1]):
        masks[np.arange(len(top)), top[:, k] >> 6] |= U64(1) << (top[:, k] & 63).astype(U64)
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(words * 8), len(top), [None, pa.py_buffer(masks.tobytes())]).cast(pa.binary())


def _described(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, np.ndarray] = broadcast.value
        for batch in batches:
            sizes = batch.column("size_of").to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                near = units(own.column("embedding")) @ pivots[int(size)].T
                words = -(-near.shape[1] // 64)
                # The common order of the postings is the pivots' own number.
                top = np.sort(np.argsort(-near, axis=1, kind="stable")[:, :min(NEAREST, near.shape[1])], axis=1)
                # Without a choice of pivots all vectors share the first one.
                posted = top[:, :POSTED if near.shape[1] > NEAREST else 1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(own) + 1, dtype=np.int32) * posted.shape[1]),
                    pa.array(posted.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [own.column("class"), own.column("label"), own.column("size_of"), own.column("copies"),
                     own.column("embedding"), _masks(top, words), _masks(posted, words), lists],
                    ["class", "label", "size_of", "copies", "embedding", "mask", "entered", "pivots"])

    return run


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    """A row of 0 and 1 for each mask, pivot 0 first."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(rows, axis=1, bitorder="little")


def _candidates(mask: np.ndarray, entered: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray,
                square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share enough nearest pivots, and no list of an earlier pivot."""
    near = mask.astype(np.float32)
    least = min(SHARED, int(near.sum(axis=1).min()))
    good = near[left] @ near[right].T >= least
    if pivot:
        before = entered[:, :pivot].astype(np.float32)
        good &= before[left] @ before[right].T == 0
    return np.nonzero(np.triu(good, 1) if square else good)


_LINKS = "a long, b long, n long"


def _verify(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles_of(batches):
            values = {n: table.column(n).to_numpy() for n in ("key", "ti", "tj", "side", "doc_id", "copies", "pivot")}
            new = np.ones(len(table), bool)
            new[1:] = np.logical_or.reduce([values[n][1:] != values[n][:-1] for n in ("key", "ti", "tj")])
            edges = np.append(np.flatnonzero(new), len(table))
            ids, copies, side = values["doc_id"], values["copies"], values["side"]
            counts = np.zeros(len(table), np.int64)
            starts, ends = [], []
            embedding = table.column("embedding").combine_chunks()
            for at, to in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if to - at < 2:
                    continue
                square = values["ti"][at] == values["tj"][at]
                rows = np.arange(to - at)
                left, right = (rows, rows) if square else (rows[side[at:to] == 0], rows[side[at:to] == 1])
                if not len(left) or not len(right):
                    continue
                i, j = _candidates(_bits(table.column("mask").slice(at, to - at)),
                                   _bits(table.column("entered").slice(at, to - at)), int(values["pivot"][at]),
                                   left, right, square)
                unit = units(embedding.slice(at, to - at))
                if 16 * len(i) > len(left) * len(right):
                    near = (unit[left] @ unit[right].T)[i, j] >= threshold
                else:
                    near = np.zeros(len(i), bool)
                    for k in range(0, len(i), PAIRS):
                        x, y = left[i[k:k + PAIRS]], right[j[k:k + PAIRS]]
                        near[k:k + PAIRS] = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = left[i[near]] + at, right[j[near]] + at
                np.add.at(counts, x, copies[y])
                np.add.at(counts, y, copies[x])
                starts.append(ids[x])
                ends.append(ids[y])
            full = np.flatnonzero(counts)
            node, root = union_find(np.concatenate([*starts, np.zeros(0, np.int64)]),
                                    np.concatenate([*ends, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(ids[full], node)), pa.array(np.append(ids[full], root)),
                 pa.array(np.append(counts[full], np.zeros(len(node), np.int64)))], ["a", "b", "n"])

    return compare


def thinned(candidates: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """At most ``most`` of the unit vectors, in order, without those close to one already taken."""
    left, taken = np.ones(len(candidates), bool), []
    while len(taken) < most and left.any():
        taken.append(int(left.argmax()))
        left &= candidates @ candidates[taken[-1]] < APART
        left[taken[-1]] = False
    return candidates[taken]


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each vector size, from the first vectors by a hash of their components."""
    out: dict[int, np.ndarray] = {}
    for row in classes.groupBy("size_of").agg(F.count("*").alias("n")).toLocalIterator():
        most = pivots_for(row["n"])
        chosen = (classes.filter(F.col("size_of") == row["size_of"]).select("embedding", "code")
                  .orderBy("code").limit(CANDIDATES * most).toPandas())
        out[row["size_of"]] = thinned(units(pa.array(chosen["embedding"].tolist(), pa.list_(pa.float64()))), most)
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and their cosine is at least ``threshold``. Null labels, null or zero
    vectors, and vectors with a null, NaN or infinite component link with nothing, and vectors of different sizes never
    link. Vectors that share fewer than ``SHARED`` of their nearest pivots, or none under which both are entered, are
    not compared.

    Rows with the same ``vec_id`` are vectors of their own: each is counted as a link of the others, and ``kept``, which
    is true where ``vec_id`` is the least of the component, holds for all of them. A null ``vec_id`` never names a
    component; without another id in the component ``component_id`` is null and the row is kept. An empty table gives no
    rows; other columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    same = ["label", "size_of", "code", "code2"]
    coded = vectors.filter(is_sound()).withColumns({
        "size_of": F.size("embedding"), "code": F.xxhash64("embedding"),
        "code2": F.xxhash64(F.lit(1), F.transform("embedding", lambda x: -x))})
    members = pinned(coded.select("vec_id", *same))
    firsts = pinned(members.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                    .withColumn("class", F.monotonically_increasing_id()))
    # Rows that repeat the first row of their class are equal in every column.
    chosen = coded.join(firsts, same).filter(F.col("vec_id").eqNullSafe(F.col("first")))
    classes = pinned(chosen.groupBy(*same).agg(
        F.first("class").alias("class"), F.first("copies").alias("copies"), F.first("embedding").alias("embedding")))
    broadcast = vectors.sparkSession.sparkContext.broadcast(_pivots(classes))
    label_type = classes.schema["label"].dataType.simpleString()
    vector_type = classes.schema["embedding"].dataType.simpleString()
    described = classes.select("class", "label", "size_of", "copies", "embedding").mapInArrow(
        _described(broadcast), f"class long, label {label_type}, size_of int, copies long, embedding {vector_type}, "
        "mask binary, entered binary, pivots array<int>")
    posted = pinned(described.withColumn("pivot", F.explode("pivots")).drop("pivots")
                    .withColumn("key", F.xxhash64("label", "size_of", "pivot")))
    sizes = posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    tiles = in_tiles(posted.join(sizes, "key").select(
        "key", F.col("class").alias("doc_id"), "copies", "embedding", "mask", "entered", "pivot", "size"), tile_rows)
    found = pinned(tiles.mapInArrow(_verify(threshold), _LINKS))
    comps = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "class")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    placed = firsts.join(counts, "class", "left").join(comps, "class", "left").withColumn(
        "comp", F.coalesce("comp", "class"))
    # Classes without a link are their own component; only linked ones need the least id of several classes.
    least = placed.filter(F.col("n").isNotNull()).groupBy("comp").agg(F.min("first").alias("least"))
    classed = placed.join(least, "comp", "left").select(
        *same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(F.col("n").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    linked = members.join(classed, same).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~is_sound()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
