"""Benchmark decontamination: an FM-index per shard of documents, searched backward for every benchmark window.

A shard is a bounded run of whole documents within a task. Its alphabet is the words of the benchmark; any other word and
any end of a text is a separator, and stretches between separators too short for any window are left out, as no
window fits into them. Windows are broadcast in blocks of a bounded number of rows of fixed size, one at a time; with several
blocks the documents are numbered and written once, so that hits find their row whatever its id.

Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchline.llm.fmindex import FMIndex
from wrenchline.llm.shared import fresh_name
from wrenchline.llm.textbytes import ALPHANUMERIC, U64, chunks, words
from wrenchline.session import pinned

WINDOW = 10
#: Words of a shard (a longer document is a shard of its own).
SHARD_WORDS = 1 << 20
#: Rows (window, item) that are broadcast at once, of about 100 bytes each.
BLOCK_ROWS = 200_000

SPANS = "array<struct<word:int,words:int,start:int,end:int>>"
_HITS = f"n_words long, spans {SPANS}, items array<string>"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for chunk in chunks(batch.column("text")):
                found = words(chunk, ALPHANUMERIC)
                codes = found.hashes.view(np.int64)
                out_ids, out = [], []
                for i in range(chunk.last - chunk.first):
                    own = codes[found.firsts[i]:found.firsts[i + 1]]
                    if len(own):
                        rows = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own)))
                        rows = np.unique(rows, axis=0)
                        out.extend(rows.tolist())
                        out_ids.extend([ids[chunk.first + i]] * len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_ids, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["item_id", "window"])

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (``item_id`` as string, ``window``: hashes of its words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    return items.mapInArrow(_windows(window), "item_id string, window array<long>").distinct()


@dataclass
class Block:
    """Windows of a block as codes aligned at the right, and for each the items that have it."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    item_firsts: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame, window: int) -> Block:
        rows = rows.assign(key=[tuple(w) for w in rows["window"]]).sort_values(["key", "item_id"])
        keys = rows["key"].drop_duplicates().tolist()
        lengths = np.array([len(k) for k in keys], np.int64)
        hashes = np.zeros((len(keys), window), np.int64)
        for i, key in enumerate(keys):
            hashes[i, window - len(key):] = key
        inside = np.arange(window) >= window - lengths[:, None]
        vocabulary = np.unique(hashes[inside].view(U64)) if len(keys) else np.zeros(0, U64)
        patterns = np.zeros(hashes.shape, np.int64)
        patterns[inside] = np.searchsorted(vocabulary, hashes[inside].view(U64)) + 1
        sizes = rows.groupby("key", sort=False).size().to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        return Block(vocabulary, patterns, lengths, np.concatenate([[0], np.cumsum(sizes)]),
                     rows["item_id"].to_numpy(object))


def _codes(hashes: np.ndarray, vocabulary: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """1 + place in the vocabulary, 0 for other words; ``likely`` marks the leading bits that occur there."""
    out = np.zeros(len(hashes), np.int32)
    maybe = np.flatnonzero(likely[hashes >> U64(44)])
    found = np.searchsorted(vocabulary, hashes[maybe])
    found[found == len(vocabulary)] = 0
    right = vocabulary[found] == hashes[maybe]
    out[maybe[right]] = found[right] + 1
    return out


class Shard:
    """Word codes and byte spans of a run of documents."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, codes, starts, ends, counts) -> None:
        for to, x in ((self.codes, codes), (self.starts, starts), (self.ends, ends), (self.counts, counts)):
            to.append(x)
        self.size += len(codes)

    def search(self, block: Block) -> tuple[np.ndarray, list, list]:
        """Words of each document, its merged hit spans, and its items."""
        counts = np.concatenate(self.counts)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        codes = np.concatenate(self.codes)
        n_docs = len(counts)
        spans: list[list] = [[] for _ in range(n_docs)]
        items: list[list] = [[] for _ in range(n_docs)]
        text, places = _stretches(codes, firsts, int(block.lengths.min(initial=1 << 30)))
        if not len(text):
            return counts, spans, items
        index = FMIndex(text, len(block.vocabulary) + 1)
        which, low, high = index.search(block.patterns, block.lengths)
        if not len(which):
            return counts, spans, items
        rows = np.repeat(low, high - low) + _counting(high - low)
        which = np.repeat(which, high - low)
        at = places[index.locate(rows)]
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.lengths[which], -1)
        hit = np.cumsum(cover[:-1]) > 0
        begins = hit.copy()
        begins[1:] &= ~hit[:-1]
        edges = firsts[:-1][counts > 0]
        begins[edges] = hit[edges]
        begin = np.flatnonzero(begins)
        stops = hit.copy()
        stops[:-1] &= ~hit[1:]
        stops[edges[1:] - 1] = hit[edges[1:] - 1]
        stop = np.flatnonzero(stops)
        doc = np.searchsorted(firsts, begin, "right") - 1
        starts, ends = np.concatenate(self.starts), np.concatenate(self.ends)
        for d, b, e in zip(doc.tolist(), begin.tolist(), stop.tolist(), strict=True):
            spans[d].append({"word": b - int(firsts[d]), "words": e - b + 1, "start": int(starts[b]), "end": int(ends[e])})
        pairs = np.unique(np.stack([np.searchsorted(firsts, at, "right") - 1, which]), axis=1)
        for d, w in pairs.T.tolist():
            items[d].extend(block.items[block.item_firsts[w]:block.item_firsts[w + 1]])
        return counts, spans, [sorted(set(x)) for x in items]


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _stretches(codes: np.ndarray, firsts: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of benchmark words within one document, each closed by a separator, and the place of every word."""
    known = codes > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    edges = firsts[:-1][firsts[:-1] < firsts[1:]]
    begins[edges] = known[edges]
    begin = np.flatnonzero(begins)
    stops = known.copy()
    stops[:-1] &= ~known[1:]
    stops[edges[1:] - 1] = known[edges[1:] - 1]
    length = np.flatnonzero(stops) + 1 - begin
    begin, length = begin[length >= shortest], length[length >= shortest]
    # One more place for the separator; its code is set to 0 below.
    places = np.repeat(begin, length + 1) + _counting(length + 1)
    text = codes[np.minimum(places, len(codes) - 1)]
    text[np.cumsum(length + 1) - 1] = 0
    return text, places


def _hits(broadcast, shard_words: int, passed: list[str], cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = broadcast.value
        likely = np.zeros(1 << 20, bool)
        likely[block.vocabulary >> U64(44)] = True
        shard, rows = Shard(), []

        def flush() -> pa.RecordBatch:
            nonlocal shard, rows
            counts, spans, items = shard.search(block)
            table = pa.concat_tables([pa.Table.from_batches([r]) for r in rows]).combine_chunks()
            columns = [table.column(n).combine_chunks() for n in passed]
            if cut:
                text = table.column("text").combine_chunks()
                columns[passed.index("text")] = cut_out(text, spans)
            names = list(passed)
            if not cut:
                columns += [pa.array(counts), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
                names += ["n_words", "spans", "items"]
            shard, rows = Shard(), []
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = words(chunk, ALPHANUMERIC)
                counts = np.diff(found.firsts)
                origin = np.repeat(chunk.offsets[:-1], counts)
                shard.add(_codes(found.hashes, block.vocabulary, likely) if len(block.vocabulary)
                          else np.zeros(len(found.hashes), np.int32), found.starts - origin, found.ends - origin, counts)
                piece = batch.slice(chunk.first, chunk.last - chunk.first)
                rows.append(piece if cut else piece.select(passed))
                if shard.size >= shard_words:
                    yield flush()
        if rows:
            yield flush()

    return run


_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int32()) for n in ("word", "words", "start", "end")]))


def cut_out(texts: pa.Array, spans: list[list]) -> pa.Array:
    """Texts without the byte spans; the parts left are joined by a blank."""
    out = texts.to_pylist()
    for i, own in enumerate(spans):
        if own:
            raw, at, parts = out[i].encode(), 0, []
            for span in own:
                parts.append(raw[at:span["start"]])
                at = span["end"]
            parts.append(raw[at:])
            out[i] = b" ".join(p.strip(b" ") for p in parts if p.strip(b" ")).decode()
    return pa.array(out, texts.type)


def _dealt(benchmark: DataFrame, window: int, block_rows: int) -> tuple[DataFrame, int]:
    """Windows, and the number of blocks for which they have about ``block_rows`` each at most."""
    rows = pinned(benchmark_windows(benchmark, window))
    return rows, max(1, -(-rows.count() // block_rows))


def _block(rows: DataFrame, k: int, n_blocks: int, window: int):
    """Broadcast block ``k`` of the windows, which are dealt by hash."""
    own = rows.filter(F.pmod(F.xxhash64("item_id", "window"), F.lit(n_blocks)) == k).toPandas()
    return rows.sparkSession.sparkContext.broadcast(Block.of(own, window))


def _hits_of_blocks(docs: DataFrame, key: str, rows: DataFrame, n_blocks: int, window: int, shard_words: int) -> DataFrame:
    """``key``, ``n_words``, ``spans`` and ``items`` over several blocks, of which one is broadcast at a time.

    ``key`` is a different number in every row of ``docs``, which must not change between evaluations.
    """
    docs, found = docs.select(key, "text"), None
    for k in range(n_blocks):
        block = _block(rows, k, n_blocks, window)
        own = docs.mapInArrow(_hits(block, shard_words, [key], cut=False), f"`{key}` long, {_HITS}")
        own = pinned(own if found is None else own.filter(F.size("spans") > 0))
        block.unpersist(blocking=True)
        found = own if found is None else found.unionByName(own)
    return found.groupBy(key).agg(
        F.max("n_words").alias("n_words"), F.udf(_merged, SPANS)(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _merged(spans):
    """Union of the spans of several blocks; runs only where a benchmark has more than one block."""
    out: list[dict] = []
    for s in sorted((x.asDict() for x in spans), key=lambda x: x["word"]):
        if out and s["word"] <= out[-1]["word"] + out[-1]["words"]:
            reach = s["word"] + s["words"] - out[-1]["word"]
            if reach > out[-1]["words"]:
                out[-1].update(words=reach, end=s["end"])
        else:
            out.append(s)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``spans`` (merged hit spans in words and bytes) and ``items``.

    ``items`` are the ids (as strings, sorted, distinct) of the items of which a window occurs. A null or empty text
    has no words; an item without words has no window, and rows with a null ``item_id`` are ignored. Repeated items
    count by their id. Without windows nothing is hit, and an empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows, n_blocks = _dealt(benchmark, window, block_rows)
    if n_blocks == 1:
        return docs.mapInArrow(_hits(_block(rows, 0, 1, window), shard_words, ["doc_id"], cut=False), f"doc_id {id_type}, {_HITS}")
    keyed = pinned(docs.withColumn("row", F.monotonically_increasing_id()))
    hits = _hits_of_blocks(keyed, "row", rows, n_blocks, window, shard_words)
    return keyed.select("row", "doc_id").join(hits, "row").drop("row")


def _cut(names: list[str], spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in names]
            columns[names.index("text")] = cut_out(batch.column("text"), batch.column(spans).to_pylist())
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents with every hit span cut out of ``text``; all other columns and rows stay.

    A text that consists of hits only becomes empty. See ``contamination`` for the other cases.
    """
    rows, n_blocks = _dealt(benchmark, window, block_rows)
    if n_blocks == 1:
        return docs.mapInArrow(_hits(_block(rows, 0, 1, window), shard_words, docs.columns, cut=True), docs.schema)
    row, spans = fresh_name("row", docs.columns), fresh_name("spans", docs.columns)
    keyed = pinned(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = _hits_of_blocks(keyed, row, rows, n_blocks, window, shard_words).filter(F.size("spans") > 0)
    joined = keyed.join(hits.select(row, F.col("spans").alias(spans)), row, "left")
    return joined.select(*docs.columns, spans).mapInArrow(_cut(docs.columns, spans), T.StructType(docs.schema.fields))
