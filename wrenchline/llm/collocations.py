"""Phrase collocations by Rabin-Karp fingerprints.

A scan hashes every run of words of one size by prefix polynomials and counts equal fingerprints, first within a task, then by a
shuffle. A counted fingerprint carries a pointer to a document that has it and the least and greatest of a second, independent
hash of its occurrences. Runs are counted size by size: a run can only be frequent if both runs that are one word
shorter are, and these are looked up in a bitmap of fixed size, so that most runs never reach the shuffle.

Frequent fingerprints alone become phrases: their pointers are joined with the documents, where the text is read. Where
the second hashes differ, different phrases share a fingerprint: those are counted again by their text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchline.llm.textbytes import (
    BYTE_VALUES, LOWER, U64, Chunk, chunks, constants, mix, owners, powers, span_hashes, spans,
)
from wrenchline.session import pinned

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of the broadcast bitmaps (8 MB) as a power of two, whatever the number of phrases: a fuller one prunes less.
BITMAP_BITS = 26
#: Counted fingerprints that a task gathers before it hands them on.
GATHERED = 1_000_000
#: The language of documents without one.
UNKNOWN = "und"

_BREAKS = np.zeros(256, np.int32)
_BREAKS[[10, 11, 12, 13, *b".,;:!?"]] = 1
_IN_WORD = (_BREAKS == 0) & ~np.isin(np.arange(256), [9, 32])
#: Values of the bytes in the first and in the second hash, A-Z as a-z.
_VALUES = (BYTE_VALUES, constants(256, 91)[LOWER])
_SIZES = constants(64, 17)


class Runs:
    """Words of a chunk and the fingerprints of their runs. Runs stay within a piece of a text."""

    def __init__(self, chunk: Chunk, salts: np.ndarray, bits: int):
        self.data = LOWER[chunk.data]
        self.starts, self.ends, firsts = spans(chunk.data, chunk.offsets, _IN_WORD)
        self.text = owners(firsts)
        before = np.zeros(len(chunk.data) + 1, np.int32)
        np.cumsum(_BREAKS[chunk.data], out=before[1:])
        new = np.ones(len(self.starts), bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (before[self.starts[1:]] > before[self.ends[:-1]])
        self.piece = np.cumsum(new)
        self.salts, self.mask = salts.view(U64), U64((1 << bits) - 1)
        up, self.down = powers(len(self.starts) + 1)
        self.sums = []
        for values in _VALUES:
            sums = np.zeros(len(self.starts) + 1, U64)
            np.cumsum(span_hashes(chunk.data, self.starts, self.ends, values) * up[:-1], out=sums[1:])
            self.sums.append(sums)

    def whole(self, size: int) -> np.ndarray:
        """First words of the runs of ``size`` words."""
        return np.flatnonzero(self.piece[:max(0, len(self.piece) - size + 1)] == self.piece[size - 1:])

    def prints(self, at: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
        """Hashes, of the first (0) or second (1) kind, of the runs of ``size`` words from each of ``at`` on."""
        sums = self.sums[kind]
        raw = mix((sums[at + size] - sums[at]) * self.down[at] + _SIZES[size] + self.salts[self.text[at]])
        return (raw if kind else raw & self.mask).view(np.int64)

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.data[self.starts[i]:self.ends[i]].tobytes() for i in range(at, at + size)).decode()


def _slots(prints: np.ndarray) -> np.ndarray:
    return prints & ((1 << BITMAP_BITS) - 1)


def _marked(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = _slots(prints)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def _merged(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Columns print, n, low, high, doc with one row per print."""
    order = np.argsort(rows[0], kind="stable")
    prints, n, low, high, doc = (column[order] for column in rows)
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    if not len(first):
        return [prints, n, low, high, doc]
    return [prints[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first),
            np.maximum.reduceat(high, first), np.minimum.reduceat(doc, first)]


_COUNTED = "size int, print long, n long, low long, high long, doc long"


def _batch(size: int, rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows[0]), size, np.int32)), *map(pa.array, rows)],
        ["size", "print", "n", "low", "high", "doc"])


def _read(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, Chunk, Runs]]:
    for batch in batches:
        salts = batch.column("salt").to_numpy()
        for chunk in chunks(batch.column("text")):
            yield batch, chunk, Runs(chunk, salts[chunk.first:chunk.last], bits)


def _counted(size: int, bits: int, broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        gathered: list[list[np.ndarray]] = []
        for batch, chunk, runs in _read(batches, bits):
            at = runs.whole(size)
            if size == 1:
                for salt, n in zip(runs.salts.view(np.int64).tolist(),
                                   np.bincount(runs.text, minlength=len(runs.salts)).tolist(), strict=True):
                    words[salt] += n
            else:
                starts = np.arange(len(runs.starts) - size + 2) if len(at) else at
                known = _marked(broadcast.value, runs.prints(starts, size - 1))
                at = at[known[at] & known[at + 1]]
            docs = batch.column("doc").to_numpy()[chunk.first:chunk.last]
            check = runs.prints(at, size, 1)
            gathered.append(_merged([runs.prints(at, size), np.ones(len(at), np.int64), check, check,
                                     docs[runs.text[at]]]))
            if sum(len(rows[0]) for rows in gathered) >= GATHERED:
                gathered = [_merged([np.concatenate(column) for column in zip(*gathered, strict=True)])]
                if len(gathered[0][0]) >= GATHERED // 2:
                    yield _batch(size, gathered.pop())
        if gathered:
            yield _batch(size, _merged([np.concatenate(column) for column in zip(*gathered, strict=True)]))
        if words:
            salts, n = np.array(list(words), np.int64), np.array(list(words.values()), np.int64)
            yield _batch(0, [salts, n, salts, salts, salts])

    return run


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Bits of the column ``print``; at most ``2 ** BITMAP_BITS / 64`` words reach the driver, however many rows."""
    slot = F.col("print").bitwiseAND((1 << BITMAP_BITS) - 1)
    words = prints.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit")).groupBy(
        "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[words["word"]] = words["bits"]
    return out


def _phrases(bits: int) -> Callable:
    """The text of each wanted (size, print) of a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk, runs in _read(batches, bits):
            wanted = batch.column("wanted").slice(chunk.first, chunk.last - chunk.first)
            pairs = wanted.flatten()
            asked = pd.DataFrame({
                "text": np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy()),
                "size": pairs.field("size").to_numpy(), "print": pairs.field("print").to_numpy()})
            found = []
            for size, of_size in asked.groupby("size"):
                at = runs.whole(size)
                have = pd.DataFrame({"text": runs.text[at], "print": runs.prints(at, size), "at": at})
                found.append(of_size.merge(have.drop_duplicates(["text", "print"]), on=["text", "print"]))
            rows = pd.concat(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["size"].to_numpy(np.int32)), pa.array(rows["print"].to_numpy()),
                 batch.column("lang").take(pa.array(rows["text"].to_numpy() + chunk.first)),
                 pa.array(list(map(runs.phrase, rows["at"], rows["size"])), pa.string())],
                ["size", "print", "lang", "phrase"])

    return run


def _spelled(sizes: list[int], bits: int, broadcast) -> Callable:
    """Runs whose print is marked, counted by their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk, runs in _read(batches, bits):
            langs = batch.column("lang").slice(chunk.first, chunk.last - chunk.first).to_pylist()
            counts: Counter = Counter()
            for size in sizes:
                at = runs.whole(size)
                prints = runs.prints(at, size)
                hit = np.flatnonzero(_marked(broadcast.value, prints))
                counts.update((size, p, langs[runs.text[i]], runs.phrase(i, size))
                              for i, p in zip(at[hit].tolist(), prints[hit].tolist(), strict=True))
            columns = list(zip(*counts, strict=True)) or [(), (), (), ()]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns, kinds), pa.array(list(counts.values()), pa.int64())],
                ["size", "print", "lang", "phrase", "n"])

    return run


def _source(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    # Documents without an id share a pointer; their texts tell them apart.
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))).alias("doc"), lang.alias("lang"),
                       F.xxhash64(lang).alias("salt"), "text")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST,
                     bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (salt, n) of the
    words of each language. ``bits`` is the width of the fingerprints; results do not depend on it."""
    source, context = _source(docs), docs.sparkSession.sparkContext
    levels: list[DataFrame] = []
    broadcast = None
    for size in range(1, longest + 1):
        counted = source.select("doc", "salt", "text").mapInArrow(_counted(size, bits, broadcast), _COUNTED)
        level = pinned(counted.groupBy("size", "print").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("doc").alias("doc"))
            .filter((F.col("n") >= least) | (F.col("size") == 0)))
        levels.append(level)
        if broadcast is not None:
            broadcast.unpersist()
        broadcast = context.broadcast(_bitmap(level.filter(F.col("size") == size)))
        if not broadcast.value.any():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    frequent = found.filter("size > 0")
    pointers = frequent.filter("low = high").groupBy("doc").agg(F.collect_list(F.struct("size", "print")).alias("wanted"))
    texts = source.join(pointers, "doc").select("lang", "salt", "text", "wanted").mapInArrow(
        _phrases(bits), "size int, print long, lang string, phrase string")
    read = texts.dropDuplicates(["size", "print"]).join(frequent.select("size", "print", "n"), ["size", "print"])
    phrases = read.select("lang", "size", "phrase", "n")
    shared = frequent.filter("low <> high")
    sizes = [row["size"] for row in shared.select("size").distinct().collect()]
    if sizes:
        marks = context.broadcast(_bitmap(shared))
        spelled = source.select("lang", "salt", "text").mapInArrow(
            _spelled(sizes, bits, marks), "size int, print long, lang string, phrase string, n long")
        again = spelled.join(shared.select("size", "print"), ["size", "print"], "left_semi").groupBy(
            "lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        phrases = phrases.unionByName(again)
    words = levels[0].filter("size = 0").select(F.col("print").alias("salt"), "n")
    return pinned(phrases), words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 bits: int = 64) -> DataFrame:
    """The ``top`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words.
    Candidates are phrases of 2 to ``longest`` words within a piece that occur ``a >= least`` times in the language.
    Cut in two parts that occur ``l`` and ``r`` times, a phrase scores floor(1000 a n / (l r)), where ``n`` is the number
    of words of the language; its lowest-scoring cut counts. A candidate inside a longer one that is as frequent is
    dropped. Order: score and ``a`` descending, phrase by its bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows and ids are rows of their own; an
    empty table gives no rows; other columns are ignored.
    """
    phrases, words = frequent_phrases(docs, least, longest, bits)
    parts = phrases.select("lang", "phrase", "n")
    candidates = phrases.filter("size > 1").withColumnRenamed("n", "a").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, longest), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("salt", F.xxhash64("lang")).join(words, "salt")
    # 38 digits hold the product of 1000 and two counts of up to 17 digits.
    score = F.expr("(1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div "
                   "(CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)))")
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), "
                   "i -> array_join(slice(words, i, m), ' '))))")
    covers = candidates.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("cover"))
    kept = best.join(covers, ["lang", "phrase"], "left").filter(
        F.col("cover").isNull() | (100 * F.col("cover") < 100 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
