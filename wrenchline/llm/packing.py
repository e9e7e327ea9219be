"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document longer than a sequence is cut: its first piece takes the remainder, the others fill a sequence each. The
shorter pieces are dealt into blocks of a bounded number; a block is evolved on several islands by crossover that
injects whole well-filled bins of one parent into the other, removes the bins that hold the same pieces and best-fits
the displaced ones. Between the epochs the best packing of each island moves to the next. Pieces of the bins left
poorly filled by their block are dealt again into new blocks and packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.shared import release_memory
from wrenchline.llm.textbytes import chunks
from wrenchline.llm.tokens import PieceEncoder
from wrenchline.session import pinned

SEQUENCE = 1024
END = 2
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 5
#: Bins filled less than this share go into the second deal.
WELL_FILLED = 0.98

_PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long, item long"


def _pieces(path: str, size: int, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encode = PieceEncoder(path)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                rows, out = [], []
                for i, found in enumerate(encode(chunk)):
                    ids = found.tobytes() + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    first = (n - 1) % size + 1 if n > size else n
                    edges = [0, *range(first, n + 1, size)]
                    for k in range(len(edges) - 1):
                        rows.append(chunk.first + i)
                        out.append((k, edges[k], edges[k + 1] - edges[k],
                                    zlib.crc32(ids[4 * edges[k]:4 * edges[k + 1]]), item))
                        item += 1
                own = batch.select(passed).take(pa.array(rows, pa.int64()))
                values = np.array(out, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(values[0].astype(np.int32)), *(pa.array(v) for v in values[1:])],
                    [*passed, "piece", "start", "length", "ids_crc32", "item"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, each with a number ``item`` of its own."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_pieces(tokenizer, size, ["doc_id"]), f"doc_id {id_type}, {_PIECE_COLUMNS}")


class Packing:
    """The bin of every piece, and how full each bin is."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray):
        self.bins = bins
        self.fills = np.bincount(bins, lengths).astype(np.int64)

    def worth(self, size: int) -> tuple[int, float]:
        """Fewer bins first, then fuller full ones."""
        return (-len(self.fills), float(np.square(self.fills / size).sum()))


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, fills: np.ndarray, size: int) -> Packing:
    """Put the pieces of ``order``, one by one, into the fullest bin with room, or a new one."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has r ids of room
    for b, room in enumerate((size - fills).tolist()):
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    n_bins = len(fills)
    placed = []
    for length in lengths[order].tolist():
        wide = rooms >> length
        if wide:
            room = length + (wide & -wide).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, n_bins
            n_bins += 1
        room -= length
        if room:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(b)
        placed.append(b)
    out = bins.copy()
    out[order] = placed
    return Packing(out, lengths)


def completed(lengths: np.ndarray, free: np.ndarray, size: int) -> list[np.ndarray]:
    """Pack the pieces ``free`` bin by bin: the longest one left, then again and again the one or two that fill it best."""
    own = lengths[free]
    by_length = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=size + 1)
    left, ends = counts.tolist(), np.cumsum(counts).tolist()  # the pieces of a length are taken from the end of its run
    there = counts > 0
    there[0] = False
    # Bit r of ``have``: a piece of length r is left; ``back`` has its bits the other way round.
    have, back = (int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little") for bits in (there, there[::-1]))
    alive = len(free)
    longest, bins = size, []
    while alive:
        while not left[longest]:
            longest -= 1
        taken, room, best = [], size, [longest]
        while best:
            for length in best:
                left[length] -= 1
                if length and not left[length]:
                    have ^= 1 << length
                    back ^= 1 << (size - length)
            taken += best
            room -= sum(best)
            fits = have & ((2 << room) - 1)
            one = fits.bit_length() - 1
            best = [one] if fits else []
            for both in range(room, one if fits else room, -1):
                pairs = fits & (back >> (size - both))  # bit r: pieces of r and of ``both`` - r are left
                half = both >> 1
                if 2 * half == both and left[half] < 2:
                    pairs &= ~(1 << half)
                if pairs:
                    first = pairs.bit_length() - 1
                    best = [first, both - first]
                    break
        members = []
        for length in taken:
            ends[length] -= 1
            members.append(by_length[ends[length]])
        bins.append(free[members])
        alive -= len(members)
    return bins


def crossover(lengths: np.ndarray, base: Packing, donor: Packing, size: int, random: np.random.Generator) -> Packing:
    """Inject about half of the donor's fullest bins into the base."""
    fullest = np.flatnonzero(donor.fills >= np.quantile(donor.fills, 0.5))
    injected = np.zeros(len(donor.fills), bool)
    injected[fullest[random.random(len(fullest)) < 0.5]] = True
    taken = injected[donor.bins]
    broken = np.zeros(len(base.fills), bool)
    broken[base.bins[taken]] = True
    kept = ~broken[base.bins] & ~taken
    bins = np.full(len(lengths), -1)
    _, bins[taken] = np.unique(donor.bins[taken], return_inverse=True)
    n_injected = int(bins.max(initial=-1)) + 1
    _, renamed = np.unique(base.bins[kept], return_inverse=True)
    bins[kept] = renamed + n_injected
    return refit(lengths, bins, size)


def refit(lengths: np.ndarray, bins: np.ndarray, size: int, complete: bool = False) -> Packing:
    """Best-fit the pieces without a bin (-1), longest first, or complete bins of their own with them."""
    free = np.flatnonzero(bins < 0)
    if complete:
        out, first = bins.copy(), int(bins.max(initial=-1)) + 1
        for k, members in enumerate(completed(lengths, free, size)):
            out[members] = first + k
        return Packing(out, lengths)
    placed = bins >= 0
    fills = np.bincount(bins[placed], lengths[placed]).astype(np.int64) if placed.any() else np.zeros(0, np.int64)
    return best_fit(lengths, free[np.argsort(-lengths[free], kind="stable")], bins, fills, size)


def mutated(lengths: np.ndarray, packing: Packing, size: int, random: np.random.Generator, complete: bool = False) -> Packing:
    """Empty the poorest bins and some others, and fit their pieces anew."""
    n = len(packing.fills)
    emptied = random.random(n) < (0.1 if complete else 0.03)
    emptied[np.argsort(packing.fills)[:max(1, n // (10 if complete else 50))]] = True
    bins = np.where(emptied[packing.bins], -1, packing.bins)
    _, bins[bins >= 0] = np.unique(bins[bins >= 0], return_inverse=True)
    return refit(lengths, bins, size, complete)


def evolve(lengths: np.ndarray, given: list[np.ndarray], size: int, seed: int, population: int = POPULATION,
           generations: int = GENERATIONS) -> Packing:
    """The best packing after some generations that start from the given ones and from noisy best-fit ones.

    One of the latter completes bins instead. Stops as soon as the number of bins is the least possible.
    """
    random = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // size)
    nowhere = np.full(len(lengths), -1)

    def worth(p: Packing) -> tuple[int, float]:
        return p.worth(size)

    alive = [Packing(bins, lengths) for bins in given]
    while len(alive) < population and not (alive and len(max(alive, key=worth).fills) <= least):
        if len(alive) == 1:
            alive.append(refit(lengths, nowhere, size, complete=True))
            continue
        noise = 1 + (0.0 if not alive else 0.1) * random.random(len(lengths))
        order = np.argsort(-(lengths * noise), kind="stable")
        alive.append(best_fit(lengths, order, nowhere, np.zeros(0, np.int64), size))
    best = max(alive, key=worth)
    for _ in range(generations):
        if len(best.fills) <= least:
            break
        children = []
        for k in range(population):
            a, b = random.choice(len(alive), 2, replace=False)
            base, donor = sorted((alive[a], alive[b]), key=worth, reverse=bool(k % 2))
            child = crossover(lengths, base, donor, size, random)
            children.append(mutated(lengths, child, size, random))
            children.append(mutated(lengths, alive[k], size, random, complete=True))
        alive = sorted([*alive, *children], key=worth, reverse=True)[:population]
        best = alive[0]
    return best


_EVOLVED = "block long, island int, item long, length long, bin int, fill long, offset long, n_bins int"


def _island(size: int, epoch: int):
    def run(table: pa.Table) -> pa.Table:
        block, island = table.column("block")[0].as_py(), table.column("island")[0].as_py()
        table = table.sort_by([("source", "ascending"), ("item", "ascending")])
        source = table.column("source").to_numpy()
        n = int((source == source[0]).sum())
        items, lengths = table.column("item").to_numpy()[:n], table.column("length").to_numpy()[:n]
        bins = table.column("bin").to_numpy()
        given = [bins[k:k + n] for k in range(0, len(bins), n)] if epoch else []
        best = evolve(lengths, given, size, seed=hash((block, island, epoch)) & 0xFFFFFFFF)
        order = np.lexsort((items, best.bins))
        before = np.cumsum(lengths[order]) - lengths[order]
        heads = np.flatnonzero(np.diff(best.bins[order], prepend=-1))
        offset = np.empty(n, np.int64)
        offset[order] = before - np.repeat(before[heads], np.diff(np.append(heads, n)))
        return pa.table({
            "block": pa.array(np.full(n, block, np.int64)), "island": pa.array(np.full(n, island, np.int32)),
            "item": pa.array(items), "length": pa.array(lengths), "bin": pa.array(best.bins.astype(np.int32)),
            "fill": pa.array(best.fills[best.bins]), "offset": pa.array(offset),
            "n_bins": pa.array(np.full(n, len(best.fills), np.int32))})

    return run


def _packed(items: DataFrame, size: int, block_pieces: int, deal: int) -> DataFrame:
    """``item``, ``length``, ``block``, ``bin``, ``fill`` and ``offset`` of the best island's packing of each block."""
    n_blocks = max(1, -(-items.count() // block_pieces))
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(deal)), F.lit(n_blocks)).alias("block"))
    rows = (dealt.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])))
            .withColumn("source", F.lit(0)).withColumn("bin", F.lit(-1)))
    for epoch in range(EPOCHS):
        if epoch:
            moved = rows.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
            rows = rows.withColumn("source", F.lit(0)).unionByName(moved.withColumn("source", F.lit(1)))
        rows = pinned(rows.groupBy("block", "island").applyInArrow(_island(size, epoch), _EVOLVED))
    best = rows.groupBy("block").agg(F.min(F.struct("n_bins", "island")).alias("b")).select("block", "b.island")
    return rows.join(best, ["block", "island"]).select("item", "length", "block", "bin", "fill", "offset")


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null text counts as empty; an empty text is the end id alone. Rows are packed one by one, so repeated rows and
    ids stay; an empty table gives no rows; other columns are ignored. ``tokenizer`` is the path of a tokenizer file
    that every executor can read.
    """
    pieces = pinned(token_pieces(docs, tokenizer, size))
    short = pieces.filter(F.col("length") < size)
    first = pinned(_packed(short, size, block_pieces, deal=0))
    poor = F.col("fill") < int(size * WELL_FILLED)
    second = _packed(first.filter(poor).select("item", "length"), size, block_pieces, deal=1)

    def numbered(packed: DataFrame, deal: int) -> DataFrame:
        number = F.shiftleft(F.col("block") * 2 + deal, 32) + F.col("bin")
        return packed.select("item", number.alias("sequence_id"), "offset")

    placed = numbered(first.filter(~poor), 0).unionByName(numbered(second, 1))
    full = pieces.filter(F.col("length") == size).select(
        *pieces.columns, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed, "item").select(*full.columns).unionByName(full).drop("item")
