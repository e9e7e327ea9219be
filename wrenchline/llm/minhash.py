"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of distinct word shingles; 128 minima, of which the low ``BITS`` bits are kept and packed,
   and 32 band keys of 4 whole minima.
2. Texts with equal sets form a class; only its smallest document goes on, so copies cost one row each.
3. Band buckets give candidates. They are compared in tiles of bounded size by bit counts on the packed signatures,
   corrected for chance collisions. A tile returns the best partner of each row, never all its pairs.
4. Twice the best link out of each component found so far (Boruvka's step) is confirmed on the full sets and merged.
5. Components that candidates still connect form clusters. Each cluster is compared once more in tiles, with the texts,
   and candidates between components not yet connected are confirmed there, so only links leave a tile.

A pair in no common bucket, or whose estimate is more than ``MARGIN`` below the threshold, is not compared: at the
threshold itself this loses one pair in about 10,000, and less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.graph import components, union_find
from wrenchline.llm.textbytes import NOT_SPACE, U64, Chunk, chunks, constants, mix, words
from wrenchline.session import pinned

SHINGLE = 5
THRESHOLD = 75  # per cent
BROADCAST_IDS = 400_000
PERMUTATIONS = 128
BANDS = 32
BITS = 2
#: Room for the error of the estimate: three and a half of its standard deviations at the threshold.
MARGIN = 0.16
#: A pair estimated so far above the threshold is nearly always a link.
STRONG = 0.05
TILE_ROWS = 1024
#: The first round looks into so many bands only: it joins most copies, which later rounds, in all bands, then skip.
FIRST_BANDS = 8
#: Pairs of small tiles compared at a time.
PAIR_BLOCK = 1 << 20
#: Rounds of best links; what they leave open is confirmed in tiles of related components.
ROUNDS = 2

_ROWS = 1024
#: The first round looks into so many bands only: it joins most copies, which later rounds, in all bands, then skip.
FIRST_BANDS = 8
#: Pairs of small tiles compared at a time.
PAIR_BLOCK = 1 << 20
#: All pairs between components are confirmed once there are at most so many for each document.
PAIRS_PER_DOCUMENT = 0.5

_ROWS = PERMUTATIONS // BANDS
_WORDS = PERMUTATIONS * BITS // 64
_LOW = U64(int("01" * 32, 2))
_SHINGLE_FACTORS = constants(SHINGLE, 101)
_SCALE = (constants(PERMUTATIONS, 211) >> U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (constants(PERMUTATIONS, 307) >> U64(32)).astype(np.uint32)
_BAND_FACTORS = constants(PERMUTATIONS, 401).reshape(BANDS, _ROWS)


def shingle_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within a text, and the first of each text.

    A text of fewer words than a shingle has one, its whole sequence; a text without words has none.
    """
    found = words(chunk, NOT_SPACE)
    h, firsts = found.hashes, found.firsts
    counts = np.diff(firsts)
    n = len(h) - SHINGLE + 1
    rolling = np.zeros(len(h), U64)
    for k in range(SHINGLE):
        rolling[:max(n, 0)] += h[k:k + max(n, 0)] * _SHINGLE_FACTORS[k]
    rolling = mix(rolling)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, count in enumerate(counts):
        if count >= SHINGLE:
            got = np.sort(rolling[firsts[i]:firsts[i + 1] - SHINGLE + 1])
            if len(got) > 1:
                keep = np.ones(len(got), bool)
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
        elif count:
            short = h[firsts[i]:firsts[i + 1]] * _SHINGLE_FACTORS[:count]
            got = mix(np.array([short.sum(dtype=U64) + U64(count)], U64))
        else:
            continue
        sets.append(got)
        sizes[i] = len(got)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])


def minima(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 32-bit minima for each text; texts without shingles get the largest value."""
    out = np.full((len(firsts) - 1, PERMUTATIONS), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(firsts[1:] > firsts[:-1])
    x = (hashes >> U64(32)).astype(np.uint32)
    step = 1 << 15
    # Runs of whole texts of about ``step`` shingles stay in the processor's cache for all permutations.
    begin = 0
    while begin < len(full):
        end = max(begin + 1, int(np.searchsorted(firsts[full + 1], firsts[full[begin]] + step, "right")))
        some = full[begin:end]
        low = firsts[some[0]]
        values, at = x[low:firsts[some[-1] + 1]], firsts[some] - low
        for k in range(PERMUTATIONS):
            out[some, k] = np.minimum.reduceat(values * _SCALE[k] + _SHIFT[k], at)
        begin = end
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima, ``BITS`` each, packed into rows of 64-bit words."""
    per = 64 // BITS
    bits = (low & np.uint32((1 << BITS) - 1)).astype(U64).reshape(len(low), _WORDS, per)
    return np.bitwise_or.reduce(bits << (np.arange(per, dtype=U64) * U64(BITS)), axis=2)


def mismatches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minima whose kept bits differ, from packed rows (the last axis holds their words)."""
    out = np.zeros(np.broadcast_shapes(left.shape[:-1], right.shape[:-1]), np.int16)
    for w in range(_WORDS):
        apart = left[..., w] ^ right[..., w]
        out += np.bitwise_count((apart | (apart >> U64(1))) & _LOW)
    return out


def expected_mismatches(similarity: float) -> int:
    """Mismatches at that similarity, corrected for the 2**-BITS chance that different minima agree."""
    return int(PERMUTATIONS * (1 - 2.0 ** -BITS) * (1 - similarity) + 1e-9)


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for chunk in chunks(batch.column("text")):
            hashes, firsts = shingle_hashes(chunk)
            sizes = np.diff(firsts)
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, len(sizes)), U64)
            for k in range(2):
                if len(full):
                    sums[k][full] = np.add.reduceat(mix(hashes + U64(k * 977 + 1)), firsts[:-1][full])
            low = minima(hashes, firsts)
            keys = mix((low.reshape(-1, BANDS, _ROWS).astype(U64) * _BAND_FACTORS).sum(axis=2, dtype=U64))
            sig = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(_WORDS * 8), len(low), [None, pa.py_buffer(packed(low).tobytes())]).cast(pa.binary())
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(len(low) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(chunk.first, chunk.last - chunk.first), pa.array(sizes), pa.array(sums[0].view(np.int64)),
                 pa.array(sums[1].view(np.int64)), sig, bands],
                ["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: set size, two 64-bit sums over the set (equal for equal sets), packed signature, bands."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed, _SIGNED)


_PAIRS = "a long, b long, comp_a long, comp_b long, worth long"


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Put the rows of each tile together: the input is sorted by tile, a tile may cross batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and len(rest):
            table = pa.concat_tables([rest, table]).combine_chunks()
        names = ["key", "ti", "tj"]
        ends = np.ones(len(table), bool)
        if len(table):
            values = [table.column(n).to_numpy() for n in names]
            ends[:-1] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
            last = int(np.flatnonzero(ends[:-1])[-1]) + 1 if ends[:-1].any() else 0
            if last:
                yield table.slice(0, last)
            rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest


class _Best:
    """For each row of a table its most promising partner.

    A pair estimated well above the threshold is strong. A row prefers a strong partner with many strong partners, which is
    the middle of a group of copies, so that groups merge in few rounds; then the fewest mismatches, then the
    smallest id. The order of preference is one number, ``worth``.
    """

    def __init__(self, doc: np.ndarray, strong: int):
        self.doc, self.strong, self.worth = doc, strong, np.full(len(doc), -1)
        self.partner = np.full(len(doc), -1)

    def rate(self, apart: np.ndarray, degree: np.ndarray) -> np.ndarray:
        return np.where(apart <= self.strong, degree + 1, 0) * (PERMUTATIONS + 1) + PERMUTATIONS - apart

    def offer(self, rows: np.ndarray, others: np.ndarray, worth: np.ndarray) -> None:
        """Each row at most once."""
        old = self.partner[rows]
        better = (worth > self.worth[rows]) | (
            (worth == self.worth[rows]) & (old >= 0) & (self.doc[others] < self.doc[old]))
        self.worth[rows[better]], self.partner[rows[better]] = worth[better], others[better]


def _small_tiles(sig, may, starts, length, best: _Best | None):
    """All pairs of many tiles of the same few rows each."""
    i, j = np.triu_indices(int(length), 1)
    step = max(1, PAIR_BLOCK // len(i))
    for k in range(0, len(starts), step):
        at = starts[k:k + step, None]
        left, right = (at + i).ravel(), (at + j).ravel()
        apart = mismatches(sig[left], sig[right])
        near = may(left, right, apart)
        left, right, apart = left[near], right[near], apart[near]
        if best is None:
            yield left, right
            continue
        rows, others, both = np.append(left, right), np.append(right, left), np.append(apart, apart)
        degree = np.bincount(rows[both <= best.strong], minlength=len(sig))
        worth = best.rate(both, degree[others])
        order = np.lexsort((best.doc[others], -worth, rows))
        rows, others, worth = rows[order], others[order], worth[order]
        head = np.ones(len(rows), bool)
        head[1:] = rows[1:] != rows[:-1]
        best.offer(rows[head], others[head], worth[head])


def _large_tile(sig, may, left, right, square, best: _Best | None):
    """Rows ``left`` against rows ``right``, both by ascending id."""
    apart = mismatches(sig[left][:, None, :], sig[right][None, :, :])
    near = may(left[:, None], right[None, :], apart)
    if best is None:
        i, j = np.nonzero(np.triu(near, 1) if square else near)
        yield left[i], right[j]
        return
    strong = near & (apart <= best.strong)
    sides = [(left, right, 1)] if square else [(left, right, 1), (right, left, 0)]
    for own, others, axis in sides:
        some = np.flatnonzero(near.any(axis=axis))
        degree = strong.sum(axis=1 - axis)
        worth = np.where(near, best.rate(apart, degree[None, :] if axis else degree[:, None]), -1)
        at = worth.argmax(axis=axis)[some]
        best.offer(own[some], others[at], worth[some, at] if axis else worth[at, some])


class _Rows:
    """The rows of some whole tiles, and their candidate pairs."""

    def __init__(self, table: pa.Table, per_cent: int):
        self.doc, self.comp, self.side, self.size = (
            table.column(n).to_numpy() for n in ("doc_id", "comp", "side", "n_shingles"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), U64).reshape(-1, _WORDS)
        tile = [table.column(n).to_numpy() for n in ("key", "ti", "tj")]
        new = np.ones(len(table), bool)
        new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in tile])
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.starts, len(table)))
        self.square = tile[1][self.starts] == tile[2][self.starts]
        self.per_cent, self.most = per_cent, expected_mismatches(per_cent / 100 - MARGIN)

    def may(self, left: np.ndarray, right: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Different components, few mismatches, and sizes that allow the similarity."""
        x, y = self.size[left], self.size[right]
        return (self.comp[left] != self.comp[right]) & (apart <= self.most) & (
            100 * np.minimum(x, y) >= self.per_cent * np.maximum(x, y))

    def tile(self, t: int, best: _Best | None = None):
        rows = np.arange(self.starts[t], self.starts[t] + self.lengths[t])
        left, right = (rows, rows) if self.square[t] else (rows[self.side[rows] == 0], rows[self.side[rows] == 1])
        yield from _large_tile(self.sig, self.may, left, right, self.square[t], best)

    def candidates(self, best: _Best | None = None):
        """Pairs of rows, some at a time; with ``best`` they are only offered there."""
        small = self.square & (self.lengths <= 64)
        for length in np.unique(self.lengths[small]):
            if length > 1:
                at = self.starts[small & (self.lengths == length)]
                yield from _small_tiles(self.sig, self.may, at, length, best)
        for t in np.flatnonzero(~small):
            yield from self.tile(t, best)


def _partners(per_cent: int):
    """For each row of each tile its best partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles_of(batches):
            rows = _Rows(table, per_cent)
            best = _Best(rows.doc, expected_mismatches(per_cent / 100 + STRONG))
            for _ in rows.candidates(best):
                pass
            got = np.flatnonzero(best.partner >= 0)
            to = best.partner[got]
            yield _pairs(rows.doc[got], rows.doc[to], rows.comp[got], rows.comp[to], best.worth[got])

    return run


def _related(per_cent: int):
    """A spanning forest of the components that some candidate pair of a tile connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles_of(batches):
            rows = _Rows(table, per_cent)
            names, number = np.unique(rows.comp, return_inverse=True)
            seen = np.zeros(0, np.int64)
            for left, right in rows.candidates():
                seen = np.union1d(seen, number[left] * len(names) + number[right])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in union_find(
                names[seen // len(names)], names[seen % len(names)])], ["a", "b"])

    return run


def _linked(per_cent: int):
    """Confirm the candidates of each tile on the full sets of its texts, the likeliest first, as far as they connect
    components that are not connected yet; give the links found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles_of(batches):
            rows = _Rows(table, per_cent)
            text = table.column("text").combine_chunks()
            for t in range(len(rows.starts)):
                pairs = list(rows.tile(t)) if rows.lengths[t] > 1 else []
                if not pairs or not len(pairs[0][0]):
                    continue
                left, right = pairs[0]
                named, place = np.unique(np.concatenate([left, right]), return_inverse=True)
                hashes, firsts = _all_shingles(text.take(pa.array(named)))
                sets = [hashes[firsts[k]:firsts[k + 1]] for k in range(len(named))]
                order = np.argsort(mismatches(rows.sig[left], rows.sig[right]), kind="stable")
                _, group = np.unique(rows.comp[named], return_inverse=True)
                group, parent, found = group.tolist(), list(range(len(named))), []

                def root(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for x, y in zip(place[:len(left)][order].tolist(), place[len(left):][order].tolist(), strict=True):
                    u, v = root(group[x]), root(group[y])
                    if u != v and similar(sets[x], sets[y], per_cent):
                        parent[v] = u
                        found.append((x, y))
                if found:
                    at = named[np.array(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows.doc[at[:, k]]) for k in (0, 1)], ["a", "b"])

    return run


def similar(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets have at least that similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return union > 0 and 100 * both >= per_cent * union


def _pairs(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "comp_a", "comp_b", "worth"])


def in_tiles(members: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Deal members (``key``, ``doc_id``, ``size`` of the key's bucket, ...) into sorted tiles of one bucket each.

    A bucket of more than ``tile_rows`` rows is cut into blocks by document, and every pair of blocks is a tile, so
    no task holds a bucket.
    """
    blocks = F.ceil(F.col("size") / tile_rows).cast("int")
    placed = members.withColumn("_n", blocks).withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int"))
    tiles = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return (tiles.withColumn("ti", F.least("_own", "_other")).withColumn("tj", F.greatest("_own", "_other"))
            .withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
            .drop("_n", "_own", "_other", "size")
            .repartition(F.col("key"), F.col("ti"), F.col("tj")).sortWithinPartitions("key", "ti", "tj", "doc_id"))


_CONFIRMED = "a long, b long"


def _confirm(per_cent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            at = 0
            for piece in _paired(batch):
                (left, lf), (right, rf) = piece
                for i in range(len(lf) - 1):
                    x, y = left[lf[i]:lf[i + 1]], right[rf[i]:rf[i + 1]]
                    keep[at + i] = similar(x, y, per_cent)
                at += len(lf) - 1
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return confirm


def _paired(batch: pa.RecordBatch):
    """Shingles of both texts, for a few pairs at a time."""
    step = 64
    for k in range(0, len(batch), step):
        yield tuple(_all_shingles(batch.column(n).slice(k, step)) for n in ("text_a", "text_b"))


def _all_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, firsts = [], [np.zeros(1, np.int64)]
    for chunk in chunks(column):
        h, f = shingle_hashes(chunk)
        hashes.append(h)
        firsts.append(f[1:] + firsts[-1][-1])
    return np.concatenate(hashes), np.concatenate(firsts)


def named_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents in ``ids``. Up to ``BROADCAST_IDS`` ids, 8 bytes each, are broadcast, so that no other
    texts are shuffled; more are joined by shuffles."""
    ids = pinned(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


def confirmed(pairs: DataFrame, docs: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose whole shingle sets have at least that similarity."""
    pairs = pinned(pairs.select("a", "b"))
    texts = pinned(named_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))))
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(per_cent), _CONFIRMED)


def _with_components(members: DataFrame, comps: DataFrame) -> DataFrame:
    renamed = comps.select(F.col("node").alias("doc_id"), "comp")
    return members.join(renamed, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).filter("_l < _h")
    return members.join(mixed.select("key"), "key", "left_semi")


def near_duplicates(docs: DataFrame, per_cent: int = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``docs`` needs a unique, non-null integer ``doc_id`` and ``text``; other columns are ignored. A null or empty text,
    or one of white space only, has no shingles, links with nothing and is kept. Repeated texts are one class. An
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = pinned(signatures(docs))
    same_set = ["set_a", "set_b", "n_shingles"]
    with_words = signed.filter("n_shingles > 0")
    classes = pinned(with_words.groupBy(*same_set).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    single = classes.select(F.col("first").alias("doc_id"))
    members = (with_words.join(single, "doc_id", "left_semi")
               .select("doc_id", F.posexplode("bands").alias("band", "key")))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sigs = with_words.select("doc_id", "sig", "n_shingles")
    members = pinned(members.join(shared, "key").join(sigs, "doc_id")
                     .select("key", "band", "doc_id", "size", "sig", "n_shingles"))

    links: DataFrame | None = None
    open_members = members.filter(F.col("band") < FIRST_BANDS).withColumn("comp", F.col("doc_id"))
    for _ in range(ROUNDS):
        partners = in_tiles(open_members, tile_rows).mapInArrow(_partners(per_cent), _PAIRS)
        best = partners.groupBy("comp_a").agg(F.max(F.struct(
            F.col("worth"), (-F.col("comp_b")).alias("c"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("m"))
        candidates = best.select((-F.col("m.x")).alias("x"), (-F.col("m.y")).alias("y")).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = pinned(confirmed(candidates, docs, per_cent))
        links = found if links is None else links.unionByName(found)
        comps = components(links)
        open_members = pinned(_mixed(_with_components(members, comps)))

    related = pinned(in_tiles(open_members, tile_rows).mapInArrow(_related(per_cent), _CONFIRMED))
    clusters = components(related).withColumnRenamed("node", "comp_of").withColumnRenamed("comp", "key")
    docs_of = open_members.select("doc_id", "comp", "sig", "n_shingles").dropDuplicates(["doc_id"])
    inside = (docs_of.join(clusters, F.col("comp") == F.col("comp_of"), "left")
              .withColumn("key", F.coalesce("key", "comp")).drop("comp_of"))
    sizes = inside.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("_l"), F.max("comp").alias("_h"))
    inside = pinned(inside.join(sizes.filter("_l < _h").select("key", "size"), "key"))
    last = in_tiles(inside.join(named_texts(docs, inside), "doc_id"), tile_rows).mapInArrow(_linked(per_cent), _CONFIRMED)
    links = links.unionByName(pinned(last))
    comps = components(links)

    firsts = classes.filter("copies > 1").select(*same_set, "first")
    out = signed.select("doc_id", *same_set).join(firsts, same_set, "left").withColumn(
        "first", F.coalesce("first", "doc_id"))
    out = out.join(comps.select(F.col("node").alias("first"), "comp"), "first", "left").withColumn(
        "first", F.coalesce("comp", "first"))
    return out.select("doc_id", "n_shingles", F.col("first").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.col("first")).alias("kept"))
