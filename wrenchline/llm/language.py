"""Language by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. The probability of a word sums over all ways to
cut it into pieces (forward algorithm); a text is the product of its words. The piece probabilities are learned by
expectation maximisation over the same sums, from the words of a bounded sample of documents with known language; each
iteration is a job that returns one number per language and piece.

Words are runs of ASCII letters and non-ASCII characters, in lower case (A-Z), with the vocabulary's sign for a word
start in front. A word of more than ``LONGEST`` bytes is taken in runs of that many bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.llm.textbytes import U64, SpanHashes, ascii_words, chunks, owners, span_hashes, spans
from wrenchline.session import pinned

LONGEST = 32
#: Bytes of the longest piece that is used.
LONGEST_PIECE = 16
ITERATIONS = 3
#: Added to the expected count of each piece.
SMOOTHING = 0.01
#: Training sample: about so many documents of each language, none of more characters than this.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_CHARACTERS = 20_000
WORD_START = "▁".encode()
CHUNK = 4 << 20

LETTERS = ascii_words("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Vocabulary:
    """Pieces by the hash of their bytes (A-Z lower-cased), and every single byte so that any word can be cut."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.first, self.second = np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)
        number = np.arange(len(self.keys), dtype=np.int32)
        self.first[self._slot(self.keys, 44)] = number
        missed = number[self.first[self._slot(self.keys, 44)] != number]
        self.second[self._slot(self.keys[missed], 24)] = missed
        if (self.find(self.keys) != number).any():
            raise ValueError("two pieces share both slots")

    @staticmethod
    def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys >> U64(shift)).astype(np.int64) & 0xFFFFF

    @staticmethod
    def of(model_file: str) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).encode()
                if len(piece) <= LONGEST_PIECE:
                    pieces.add(piece.lower())
        joined = np.frombuffer(b"".join(sorted(pieces)), np.uint8)
        ends = np.cumsum([len(p) for p in sorted(pieces)])
        return Vocabulary(np.unique(span_hashes(joined, np.append(0, ends[:-1]), ends)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        out = self.first[self._slot(hashes, 44)]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        other = self.second[self._slot(hashes[wrong], 24)]
        other[self.keys[other] != hashes[wrong]] = -1
        out[wrong] = other
        return out


class Spans:
    """Distinct words, longest first, and the piece of each span: ``piece[end, length]`` for all words of at least ``end``
    bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary):
        begun = np.frombuffer(WORD_START, np.uint8)
        lengths = ends - starts + len(begun)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        base = np.cumsum(self.lengths) - self.lengths
        buffer = np.empty(int(self.lengths.sum()), np.uint8)
        for k, byte in enumerate(begun):
            buffer[base + k] = byte
        tail = self.lengths - len(begun)
        within = np.arange(tail.sum()) - np.repeat(np.cumsum(tail) - tail, tail)
        buffer[np.repeat(base + len(begun), tail) + within] = data[np.repeat(starts[self.order], tail) + within]
        self.longest = int(self.lengths.max(initial=0))
        self.upto = [int(np.searchsorted(-self.lengths, -end, "right")) for end in range(self.longest + 2)]
        span_hash = SpanHashes(buffer)
        self.piece = {}
        for end in range(1, self.longest + 1):
            at = base[:self.upto[end]]
            for length in range(1, min(end, LONGEST_PIECE) + 1):
                # The start sign is three bytes: spans that begin or end within it are no pieces.
                if end < len(begun) or 0 < end - length < len(begun):
                    continue
                self.piece[end, length] = vocabulary.find(span_hash(at + end - length, at + end))

    def forward(self, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums over all cuts of each prefix, and of the words. ``table``: a row of probabilities per piece, a zero row
        at the end for spans that are none."""
        alpha = [np.ones((len(self.lengths), table.shape[1]))]
        whole = np.zeros((len(self.lengths), table.shape[1]))
        for end in range(1, self.longest + 1):
            total = np.zeros((self.upto[end], table.shape[1]))
            for length in range(1, min(end, LONGEST_PIECE) + 1):
                piece = self.piece.get((end, length))
                if piece is not None:
                    some = np.flatnonzero(piece >= 0)
                    total[some] += alpha[end - length][some] * table[piece[some]]
            alpha.append(total)
            whole[self.upto[end + 1]:self.upto[end]] = total[self.upto[end + 1]:]
        return alpha, whole

    def expected(self, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one language, each word taken ``counts`` times."""
        alpha, whole = self.forward(table[:, None])
        out = np.zeros(len(table))
        beta: list = [None] * (self.longest + 1)
        for end in range(self.longest, 0, -1):
            n = self.upto[end]
            value = np.zeros(n)
            value[self.upto[end + 1]:] = 1
            for length in range(1, min(LONGEST_PIECE, self.longest - end) + 1):
                piece = self.piece.get((end + length, length))
                if piece is not None:
                    m = self.upto[end + length]
                    value[:m] += np.where(piece >= 0, table[piece], 0) * beta[end + length]
            beta[end] = value
            per = counts[:n] / np.maximum(whole[:n, 0], 1e-300)
            for length in range(1, min(end, LONGEST_PIECE) + 1):
                piece = self.piece.get((end, length))
                if piece is not None:
                    some = np.flatnonzero(piece >= 0)
                    used = alpha[end - length][some, 0] * table[piece[some]] * value[some] * per[some]
                    out += np.bincount(piece[some], used, len(out))
        return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words, cut into runs of ``LONGEST`` bytes, and the first of each text."""
    starts, ends, firsts = spans(data, offsets, LETTERS)
    if len(starts) and (ends - starts).max() > LONGEST:
        parts = -(-(ends - starts) // LONGEST)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + within * LONGEST
        ends = np.minimum(starts + LONGEST, stop)
        firsts = np.concatenate([[0], np.cumsum(parts)])[firsts]
    return starts, ends, firsts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language with their counts, for the texts of a chunk."""
    for batch in batches:
        languages = np.array(batch.column("lang").to_pylist(), object)
        for chunk in chunks(batch.column("text"), CHUNK):
            starts, ends, firsts = letter_runs(chunk.data, chunk.offsets)
            names, number = np.unique(languages[chunk.first:chunk.last].astype(str), return_inverse=True)
            hashes = span_hashes(chunk.data, starts, ends)
            of = number[owners(firsts)]
            order = np.lexsort((hashes, of))
            head = np.ones(len(order), bool)
            head[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
            at = np.flatnonzero(head)
            one = order[at]
            raw = chunk.data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[of[one]].tolist(), pa.string()),
                 pa.array([raw[s:e].lower() for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)],
                          pa.binary()), pa.array(np.diff(np.append(at, len(order))), pa.int64())], ["lang", "word", "n"])


def _expected(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pandas()
            for language, own in rows.groupby("lang"):
                data = np.frombuffer(b"".join(own["word"]), np.uint8)
                ends = np.cumsum(own["word"].map(len).to_numpy(np.int64))
                starts = np.append(0, ends[:-1])
                found = Spans(data, starts, ends, model.vocabulary)
                used = found.expected(model.table[:, model.languages.index(language)],
                                      own["n"].to_numpy(np.float64)[found.order])
                piece = np.flatnonzero(used)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(piece)), pa.array(piece.astype(np.int32)), pa.array(used[piece])],
                    ["lang", "piece", "used"])

    return run


@dataclass
class Model:
    """Languages in order; probability of each piece in each of them, with a zero row at the end; share of each."""

    vocabulary: Vocabulary
    languages: list[str]
    table: np.ndarray
    shares: np.ndarray


def train_languages(docs: DataFrame, vocabulary_file: str, sample: int = SAMPLE_DOCUMENTS,
                    iterations: int = ITERATIONS) -> Model:
    """Learn from ``text`` and ``lang`` of ``docs``: shares of the languages from all rows, piece probabilities from a
    sample of about ``sample`` documents of each language, chosen by a hash of their text."""
    known = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = known.groupBy("lang").count().toPandas().sort_values("lang")
    vocabulary = Vocabulary.of(vocabulary_file)
    languages = sizes["lang"].tolist()
    pieces = len(vocabulary.keys)
    table = np.zeros((pieces + 1, len(languages)))
    table[:-1] = 1 / pieces
    model = Model(vocabulary, languages, table, (sizes["count"] / sizes["count"].sum()).to_numpy(np.float64))
    if not languages:
        return model
    spark = docs.sparkSession
    chosen = F.lit(False)
    for language, count in zip(languages, sizes["count"], strict=True):
        share = min(1.0, sample / count)
        chosen = F.when(F.col("lang") == language, F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)
                        ).otherwise(chosen)
    texts = known.filter(F.length("text") <= SAMPLE_CHARACTERS).filter(chosen)
    words = pinned(texts.mapInArrow(_counted, "lang string, word binary, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")).coalesce(spark.sparkContext.defaultParallelism))
    for _ in range(iterations):
        broadcast = spark.sparkContext.broadcast(model)
        used = (words.mapInArrow(_expected(broadcast), "lang string, piece int, used double")
                .groupBy("lang", "piece").agg(F.sum("used").alias("used")).toPandas())
        expected = np.zeros((pieces, len(languages)))
        expected[used["piece"], pd.Index(languages).get_indexer(used["lang"])] = used["used"]
        expected += SMOOTHING
        table = np.zeros_like(model.table)
        table[:-1] = expected / expected.sum(axis=0)
        model = Model(vocabulary, languages, table, model.shares)
    return model


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _predicted(broadcast, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        names = [*model.languages, "und"]
        ascii_letter = LETTERS.copy()
        ascii_letter[128:] = False
        for batch in batches:
            texts = batch.column("text")
            for chunk in chunks(texts, CHUNK):
                n = chunk.last - chunk.first
                total = np.tile(np.log(model.shares), (n, 1)) if model.languages else np.zeros((n, 0))
                starts, ends, firsts = letter_runs(chunk.data, chunk.offsets)
                if len(starts) and model.languages:
                    hashes = span_hashes(chunk.data, starts, ends)
                    _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
                    found = Spans(chunk.data, starts[one], ends[one], model.vocabulary)
                    _, whole = found.forward(model.table)
                    logs = np.empty_like(whole)
                    logs[found.order] = np.log(np.maximum(whole, 1e-300))
                    owner = owners(firsts)
                    for k in range(len(model.languages)):
                        total[:, k] += np.bincount(owner, logs[number, k], n)
                letters = np.concatenate([[0], np.cumsum(ascii_letter[chunk.data])])[chunk.offsets]
                has_letter = letters[1:] > letters[:-1]
                for i in np.flatnonzero(~has_letter):
                    has_letter[i] = _has_letter(texts[chunk.first + int(i)].as_py())
                if model.languages:
                    odds = np.exp(total - total.max(axis=1, keepdims=True))
                    score = odds.max(axis=1) / odds.sum(axis=1)
                    best = np.where(has_letter, total.argmax(axis=1), len(model.languages))
                    score[~has_letter] = 0
                else:
                    best, score = np.zeros(n, np.int64), np.zeros(n)
                own = batch.slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in passed), pa.array([names[b] for b in best.tolist()], pa.string()),
                     pa.array(score)], [*passed, "lang_pred", "score"])

    return run


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (the share of the best language in the posterior) of every document.

    Null and empty texts and texts without a letter are ``und`` with score 0, and so is every text if no language was
    learned. Equal scores go to the first language by name. Rows are scored one by one, so repeated rows stay; an
    empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predicted(broadcast, ["doc_id"]), f"doc_id {id_type}, lang_pred string, score double")
