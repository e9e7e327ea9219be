"""Importance resampling against a plain version, and the radix sort against sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import ODD_TEXTS, SF, ascii_lower, documents
from wrenchline.llm.crc import run_crcs, word_crcs
from wrenchline.llm.queries import QUERIES, table
from wrenchline.llm.radix import radix_ranks
from wrenchline.llm.resampling import resample


def _features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target):
    """Rows (id, text) and target texts to sorted rows of the result."""
    own = [(i, *_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in _features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
            for b in range(10000)]
    scored = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {}
    for k, r in enumerate(able[:5 * len(able) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in scored), key=str)


def _same(df, rows, target):
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert df.columns == columns and {t for _, t in df.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in df.collect()), key=str) == plain(rows, target)


def test_whole_tables(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    _same(QUERIES["op13_radix_resampling"](spark, SF).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank"), rows, target)


def test_odd_texts_null_and_repeated_ids(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "delta", "x" * 90, "7"]
    texts = [*ODD_TEXTS, *[" ".join(rng.choices(words, k=25)) for _ in range(60)], *["many equal words " * 9] * 40]
    docs = documents(spark, texts).selectExpr(
        "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id > 90 THEN 90 ELSE doc_id END AS doc_id", "text",
        "'x' AS rank", "'x' AS weight", "'x' AS row")
    target = documents(spark, ["alpha Beta gämma", None, ""]).select("text")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    _same(resample(docs, target), rows, ["alpha Beta gämma"])
    _same(resample(docs, target.filter("false")), rows, [])
    assert resample(docs.filter("false"), target).count() == 0
    assert resample(docs.filter("text IS NULL"), target).filter("rank IS NOT NULL OR weight <> 0").count() == 0


@pytest.mark.parametrize("keys", ["id % 7", "0", "id * 1000003 % 5000000", "(1L << 40) - id"])
def test_ranks_over_many_blocks(spark, keys):
    rows = spark.range(0, 3000, numPartitions=5).selectExpr(f"CAST({keys} AS BIGINT) AS a", "(id * 37) % 11 AS b", "id")
    got = radix_ranks(rows, ["a", "b"], "id", block_rows=64, digit_bits=5)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 3001))
    ordered = [tuple(r) for r in got.join(rows, "id").orderBy("rank").select("a", "b").collect()]
    assert ordered == sorted(ordered)


def test_checksums_of_runs():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcé0", k=rng.choice([1, 3, 8, 63, 64, 65, 200, 5000]))) for _ in range(80)]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    sizes = np.array([len(r) for r in raw])
    runs = run_crcs(word_crcs(np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends), sizes, 4)
    for k, got in enumerate(runs):
        assert got.tolist() == [zlib.crc32(" ".join(words[i:i + k + 1]).encode()) for i in range(len(words) - k)]
