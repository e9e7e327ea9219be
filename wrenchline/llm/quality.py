"""Quality: supervised subword embeddings. Hashed word and character n-gram vectors are averaged per text and go
through a softmax layer; vectors and layer are learned together by stochastic gradient descent in numpy.

Features are words, the character n-grams within them, and pairs of neighbouring words. A pair of equal words is one
feature whatever the word is, so that repetition is learned once for all words.

For scoring, the product of each bucket's vector with the output layer is formed once: the mean of the products is the
product of the mean, so texts are scored by one number per bucket and class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wrenchline.llm.shared import fresh_name, labelled_sample
from wrenchline.llm.textbytes import (NOT_SPACE, U64, Chunk, SpanHashes, chunks, constants, mix, owners, per_text,
                                      spans)

BUCKETS = 1 << 17
DIMENSIONS = 8
#: Characters of the n-grams within a word.
GRAMS = (3, 4)
SAMPLE_ROWS = 2_000
SAMPLE_CHARACTERS = 20_000
EPOCHS = 8
RATE = 0.5

#: Case counts here: shouting is a sign of poor text.
_VALUES = constants(256, 601)
_PAIR = constants(3, 607)


@dataclass
class Subwords:
    """Buckets of the distinct words of a chunk and of their n-grams, with the word of each; the hashes of the words;
    the word number at every place of the chunk, and the first place of each text."""

    buckets: np.ndarray
    word_of: np.ndarray
    hashes: np.ndarray
    numbers: np.ndarray
    firsts: np.ndarray


def subwords(chunk: Chunk) -> Subwords:
    starts, ends, firsts = spans(chunk.data, chunk.offsets, NOT_SPACE)
    span_hash = SpanHashes(chunk.data, _VALUES)
    hashes = span_hash(starts, ends)
    kinds, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    buckets, word_of = [kinds], [np.arange(len(first))]
    # Character starts of the distinct words, word by word.
    lengths = ends - starts
    at = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    word = np.repeat(np.arange(len(first)), lengths)
    begin = (chunk.data[at] & 0xC0) != 0x80
    at, word = at[begin], word[begin]
    for k in GRAMS:
        inside = np.flatnonzero(word[:len(word) - k + 1] == word[k - 1:]) if len(word) >= k else np.zeros(0, np.int64)
        beyond = np.minimum(inside + k, len(at) - 1)
        within = (inside + k < len(at)) & (word[beyond] == word[inside])
        stop = np.where(within, at[beyond], ends[word[inside]])
        buckets.append(span_hash(at[inside], stop) + U64(k))
        word_of.append(word[inside])
    return Subwords((np.concatenate(buckets) >> U64(20)).astype(np.int64) % BUCKETS, np.concatenate(word_of), kinds,
                    numbers, firsts)


def word_pairs(numbers: np.ndarray, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every pair of neighbouring words."""
    owner = owners(firsts)
    left = np.flatnonzero(owner[:-1] == owner[1:])
    own = hashes[numbers]
    code = mix(own[left] * _PAIR[0] + own[left + 1] * _PAIR[1])
    code[numbers[left] == numbers[left + 1]] = _PAIR[2]
    return (code >> U64(20)).astype(np.int64) % BUCKETS, owner[left]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            found = subwords(chunk)
            by_word = np.argsort(found.word_of, kind="stable")
            buckets = found.buckets[by_word]
            begin = np.searchsorted(found.word_of[by_word], np.arange(len(found.hashes) + 1))
            pair, pair_owner = word_pairs(found.numbers, found.hashes, found.firsts)
            pair_firsts = np.searchsorted(pair_owner, np.arange(chunk.last - chunk.first + 1))
            ids, counts = [], []
            for i in range(chunk.last - chunk.first):
                own, times = np.unique(found.numbers[found.firsts[i]:found.firsts[i + 1]], return_counts=True)
                sizes = begin[own + 1] - begin[own]
                places = np.repeat(begin[own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pairs = pair[pair_firsts[i]:pair_firsts[i + 1]]
                every = np.concatenate([buckets[places], pairs])
                weight = np.concatenate([np.repeat(times, sizes), np.ones(len(pairs), np.int64)])
                kinds, which = np.unique(every, return_inverse=True)
                ids.append(kinds.astype(np.int32))
                counts.append(np.bincount(which, weight).astype(np.float32))
            own = batch.slice(chunk.first, chunk.last - chunk.first)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("label"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.float32()))], ["doc_id", "label", "buckets", "counts"])


@dataclass
class Model:
    """For each bucket the difference of its class outputs, and the intercept."""

    outputs: np.ndarray
    intercept: float


def fit_subwords(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
                 seed: int = 1) -> Model:
    """SGD over (buckets, counts, label): one step a text, in a new fixed order each epoch, rate falling to zero."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    step, steps = 0, epochs * len(examples)
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            buckets, counts, label = examples[i]
            now = rate * (1 - step / steps)
            step += 1
            share = counts / max(counts.sum(), 1)
            mean = share @ vectors[buckets]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            pull = layer @ p
            layer -= now * np.outer(mean, p)
            bias -= now * p
            # The usual mean gives each vector the whole pull divided by the text's length; the learning rate of
            # the vectors is raised in its place, as texts have hundreds of features.
            vectors[buckets] -= (now * 100) * share[:, None] * pull
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a sample of at most ``rows`` labelled documents, half of each label where there are enough.

    Without rows of both labels every text gets 0.5.
    """
    sample = labelled_sample(docs, labels, label, rows, SAMPLE_CHARACTERS)
    got = sample.mapInArrow(_featured, "doc_id long, label int, buckets array<int>, counts array<float>").toPandas()
    got = got.sort_values("doc_id")
    if got["label"].nunique() < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    return fit_subwords([(np.asarray(b, np.int32), np.asarray(c, np.float32), y)
                         for b, c, y in zip(got["buckets"], got["counts"], got["label"], strict=True)])


def _scored(broadcast, passed: list[str], score_name: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = subwords(chunk)
                n_words, n_texts = len(found.hashes), chunk.last - chunk.first
                output = np.bincount(found.word_of, model.outputs[found.buckets], n_words)
                size = np.bincount(found.word_of, minlength=n_words).astype(np.float64)
                pair, owner = word_pairs(found.numbers, found.hashes, found.firsts)
                total = per_text(output[found.numbers], found.firsts) + np.bincount(owner, model.outputs[pair], n_texts)
                features = per_text(size[found.numbers], found.firsts) + np.bincount(owner, minlength=n_texts)
                mean = total / np.maximum(features, 1)
                score = 1 / (1 + np.exp(-np.clip(mean + model.intercept, -35, 35)))
                own = batch.slice(chunk.first, chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in passed), pa.array(score)], [*passed, score_name])

    return run


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: good likelier) of every document, from its whole text alone.

    A null or empty text gets the score of the intercept. Rows are scored one by one, so repeated rows and ids stay; an
    empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(broadcast, ["doc_id"]), f"doc_id {id_type}, score double")


def good_documents(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    score = fresh_name("score", docs.columns)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.mapInArrow(_scored(broadcast, docs.columns, score), T.StructType(
        [*docs.schema.fields, T.StructField(score, T.DoubleType())]))
    return scored.filter(F.col(score) >= least).drop(score)
