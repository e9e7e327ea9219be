"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Per-coordinate rates let rare words move fast; the L1 term keeps most weights at exactly zero, so the model that
is broadcast is a short list of buckets. A feature counts once per text, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.shared import labelled_sample
from wrenchline.llm.textbytes import ALPHANUMERIC, U64, Chunk, chunks, constants, mix, owners, words

BUCKETS = 1 << 20
#: Training sample: rows, and characters of its longest text.
SAMPLE_ROWS = 4_000
SAMPLE_CHARACTERS = 20_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 12.0, 0.1
#: Examples of the rarer label count up to so many times.
MOST_WEIGHT = 8.0

#: Word distances of the features: single words, neighbours, and pairs that skip one or two words.
GAPS = (0, 1, 2, 3)
_FACTORS = constants(2 * len(GAPS), 503).reshape(len(GAPS), 2)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a chunk, and the text of each."""
    found = words(chunk, ALPHANUMERIC)
    owner = owners(found.firsts)
    buckets, texts = [], []
    for gap, (left, right) in zip(GAPS, _FACTORS, strict=True):
        h = found.hashes
        if gap:
            same = np.flatnonzero(owner[:-gap] == owner[gap:])
            code = mix(h[same] * left + h[same + gap] * right)
            texts.append(owner[same])
        else:
            code = mix(h * left)
            texts.append(owner)
        buckets.append((code >> U64(44)).astype(np.int64))
    return np.concatenate(buckets), np.concatenate(texts)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            buckets, texts = features(chunk)
            pairs = np.unique(texts * BUCKETS + buckets)
            firsts = np.searchsorted(pairs, np.arange(chunk.last - chunk.first + 1) * BUCKETS)
            listed = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)),
                                              pa.array((pairs % BUCKETS).astype(np.int32)))
            own = batch.slice(chunk.first, chunk.last - chunk.first)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("label"), listed],
                                             ["doc_id", "label", "buckets"])


@dataclass
class Model:
    """Buckets with a weight other than zero, their weights, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def fit_ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
             l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal over (distinct buckets, label), in the given order, ``epochs`` times.

    The gradients of each label are weighted so that both count alike, within ``MOST_WEIGHT``.
    """
    ones = sum(label for _, label in examples)
    share = (len(examples) - ones) / max(ones, 1)
    worth = (min(max(1 / share if share else 1, 1), MOST_WEIGHT), min(max(share, 1), MOST_WEIGHT))
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    bias = np.array([BUCKETS], np.int32)

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        w = -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(own) <= l1] = 0
        return w

    for _ in range(epochs):
        for buckets, label in examples:
            at = np.append(buckets, bias)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - label) * worth[label]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    weights = weight(np.arange(BUCKETS + 1))
    kept = np.flatnonzero(weights[:-1])
    return Model(kept, weights[kept], float(weights[-1]))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of at most ``rows`` labelled documents, half of each label where there are enough.

    Without rows of both labels the model has no weights and gives every text 0.5.
    """
    sample = labelled_sample(docs, labels, label, rows, SAMPLE_CHARACTERS)
    got = sample.mapInArrow(_featured, "doc_id long, label int, buckets array<int>").toPandas()
    got = got.assign(order=mix(got["doc_id"].to_numpy(np.int64).view(U64))).sort_values(["order", "doc_id"])
    if got["label"].nunique() < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return fit_ftrl([(np.asarray(b, np.int32), y) for b, y in zip(got["buckets"], got["label"], strict=True)])


def _scored(broadcast, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        used = np.zeros(BUCKETS, bool)
        used[model.buckets] = True
        weights = np.zeros(BUCKETS)
        weights[model.buckets] = model.weights
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                buckets, texts = features(chunk)
                hit = used[buckets]
                pairs = np.unique(texts[hit] * BUCKETS + buckets[hit])
                total = np.bincount(pairs // BUCKETS, weights[pairs % BUCKETS], chunk.last - chunk.first)
                score = 1 / (1 + np.exp(-np.clip(total + model.intercept, -35, 35)))
                own = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in passed), pa.array(score)], [*passed, "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: toxic likelier) of every document, from its whole text alone.

    A null or empty text gets the score of the intercept. Rows are scored one by one, so repeated rows and repeated ids
    stay; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(broadcast, ["doc_id"]), f"doc_id {id_type}, score double")


def predicted(score: str, least: float):
    """1 where the score is at least ``least``."""
    return (F.col(score) >= least).cast("int").alias("predicted")
