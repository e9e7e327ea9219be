"""Importance resampling of documents towards a target text: hashed word runs, Gumbel scores, ranks by a radix sort.

Every run of one to three words falls into one of ``BUCKETS`` buckets by its CRC-32. The counts of all documents and of
all target texts give each bucket a gain, a document's weight is the sum over its runs, and a document is drawn with a
probability that grows with its weight: the drawn ones have the highest sums of weight and a Gumbel number made from the
id. Only the counts and gains, ``BUCKETS`` numbers, pass the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.crc import run_crcs, word_crcs
from wrenchline.llm.radix import radix_ranks
from wrenchline.llm.textbytes import ALPHANUMERIC, LOWER, Chunk, chunks, owners, spans
from wrenchline.session import pinned

BUCKETS = 10_000
#: Words of the longest run.
RUN = 3
PERCENT = 5
LEAST_WORDS = 20
SEED = 42


def _runs(chunk: Chunk) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for every run length the text and the bucket of each run."""
    data = LOWER[chunk.data]
    starts, ends, firsts = spans(data, chunk.offsets, ALPHANUMERIC)
    text = owners(firsts)
    out = []
    for k, crcs in enumerate(run_crcs(word_crcs(data, starts, ends), ends - starts, RUN)):
        whole = np.flatnonzero(text[:len(crcs)] == text[k:]) if k else slice(None)
        out.append((text[:len(crcs)][whole], (crcs[whole] % np.uint32(BUCKETS)).astype(np.int64)))
    return np.diff(firsts), out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            for _, buckets in _runs(chunk)[1]:
                total += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Runs in each bucket over the ``text`` column of all rows."""
    counted = texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counted["bucket"]] = counted["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed ratio of shares) of each bucket."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = broadcast.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                words, runs = _runs(chunk)
                features, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for text, buckets in runs:
                    features += np.bincount(text, minlength=len(words))
                    # Sums of whole numbers below 2 ** 53 are exact in doubles.
                    weight += np.bincount(text, gains[buckets], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, len(words)), pa.array(words), pa.array(features),
                     pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(ids: str, seed: int):
    """floor(1000 * Gumbel number) from the first 32 bits of sha256("seed:id"); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ids).cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (all long).

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn: those of
    the highest score, ties to the smaller id, ranked from 1; others have a null rank. Null and empty texts have no
    runs and weight 0. Repeated rows are rows of their own, with different ranks; among equal ids and scores any comes
    first. A null id comes last among ties. Empty documents give no rows; an empty target has no counts. Other columns
    are ignored.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    broadcast = docs.sparkSession.sparkContext.broadcast(gains)
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _weighed(broadcast), "doc_id long, n_words long, n_features long, weight long")
    scored = pinned(weighed.withColumn("score", F.col("weight") + gumbel("doc_id", seed))
                    .withColumn("row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words)
    seen = able.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("doc_id").alias("low"),
                    F.max("doc_id").alias("high")).first()
    draw, low, high = percent * seen["n"] // 100, seen["low"] or 0, seen["high"] or 0
    ranks = radix_ranks(able.select(
        (F.lit(seen["top"] or 0) - F.col("score")).alias("below"),
        F.coalesce(F.col("doc_id") - F.lit(low), F.lit(high - low + 1)).alias("place"), "row"), ["below", "place"], "row")
    return scored.join(ranks.filter(F.col("rank") <= draw), "row", "left").drop("row")
