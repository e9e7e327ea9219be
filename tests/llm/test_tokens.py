from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import ODD_TEXTS, SF, documents, texts_of
from wrenchline.llm import packing
from wrenchline.llm.offsets import section_tokens
from wrenchline.llm.packing import pack
from wrenchline.llm.queries import QUERIES
from wrenchline.llm.textbytes import chunks
from wrenchline.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_tokenizers_ids(tokenizer, monkeypatch):
    random.seed(1)
    signs = ["a", "s", "t", "re", "ll", "lll", "d", "’", "—", "B", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "\x1c", "\x85", "\xa0", "ª", "²", "中", "한", "Ж", "٣", "!", "😀", "　"]
    texts = ODD_TEXTS[:8] + ODD_TEXTS[10:] + ["".join(random.choices(signs, k=random.randint(0, 12))) for _ in range(6000)]
    monkeypatch.setattr("wrenchline.llm.tokens.CACHED_PIECES", 500)
    encode = PieceEncoder(PATH)
    for k in range(0, len(texts), 100):
        some = texts[k:k + 100]
        for chunk in chunks(pa.array(some, pa.string()), 300):
            for text, ids in zip(some[chunk.first:chunk.last], encode(chunk), strict=True):
                assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def check_packing(rows, texts, tokenizer, size=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    total = 0
    for doc, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            assert r["length"] == size or r["piece"] == 0
            at += r["length"]
        assert at == len(ids) and len(own) == max(1, -(-len(ids) // size))
        total += at
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence), -(-total // size)


def test_packing_query(spark, tokenizer):
    rows = QUERIES["op10_grouping_genetic"](spark, SF).collect()
    n, least = check_packing(rows, texts_of(spark.read.parquet(f"{SF}/documents.parquet")), tokenizer)
    assert n <= least * 1.02 + 1


def test_packing_of_odd_texts_in_small_blocks(spark, tokenizer):
    docs = documents(spark, ODD_TEXTS + ["some more words " * k for k in range(40)])
    clash = docs.withColumns({c: F.lit(1) for c in ("piece", "item", "bin", "sequence_id")})
    rows = pack(clash, PATH, size=64, block_pieces=10).collect()
    check_packing(rows, texts_of(docs), tokenizer, 64)
    assert pack(docs.limit(0), PATH).count() == 0
    twice = pack(docs.limit(6).unionByName(docs.limit(6)), PATH)
    assert twice.count() == 12


def test_crossover_keeps_every_piece_once():
    numbers = np.random.default_rng(3)
    lengths = numbers.integers(1, 1024, 500)
    first = packing.evolve(lengths, [], 1024, seed=1, generations=0)
    order = numbers.permutation(500)
    second = packing.best_fit(lengths, order, np.full(500, -1), np.zeros(0, np.int64), 1024)
    for k in range(5):
        child = packing.crossover(lengths, second, first, 1024, np.random.default_rng(k))
        assert (child.bins >= 0).all() and child.fills.max() <= 1024 and child.fills.sum() == lengths.sum()
        child = packing.mutated(lengths, child, 1024, np.random.default_rng(k))
        assert (child.bins >= 0).all() and child.fills.max() <= 1024 and (child.fills > 0).all()
    best = packing.evolve(lengths, [second.bins], 1024, seed=2)
    assert len(best.fills) <= min(len(first.fills), len(second.fills))


def check_sections(rows, texts, tokenizer):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r["section"])
        text = texts[doc] or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
        edges = np.cumsum([0, *map(len, lines)])
        assert [r["start"] for r in own] == edges[:-1].tolist() and [r["stop"] for r in own] == edges[1:].tolist()
        spans = tokenizer.encode(text, add_special_tokens=False).offsets
        counts, crossing = [0] * len(lines), [0] * len(lines)
        for start, stop in spans:
            k = int(np.searchsorted(edges, start, "right")) - 1
            counts[k] += 1
            crossing[k] += stop > edges[k + 1]
        assert [r["n_tokens"] for r in own] == counts and [r["n_crossing"] for r in own] == crossing


def test_section_query(spark, tokenizer):
    rows = QUERIES["op9_offset_attribution"](spark, SF).collect()
    check_sections(rows, texts_of(spark.read.parquet(f"{SF}/documents.parquet")), tokenizer)


def test_sections_of_odd_texts(spark, tokenizer):
    texts = ODD_TEXTS + ["a\n\n\nb", "\n\nx", "x \n \n y\n", "tail\n"]
    docs = documents(spark, texts)
    check_sections(section_tokens(docs.withColumn("section", F.lit(1)), PATH).collect(), texts_of(docs), tokenizer)
    assert section_tokens(docs.limit(0), PATH).count() == 0


def test_generations_save_bins_where_best_fit_does_not():
    random = np.random.default_rng(8)
    for low, high in ((300, 600), (250, 500)):
        lengths = random.integers(low, high, 1500)
        order = np.argsort(-lengths, kind="stable")
        fitted = packing.best_fit(lengths, order, np.full(1500, -1), np.zeros(0, np.int64), 1024)
        start = packing.evolve(lengths, [], 1024, seed=3, generations=0)
        best = packing.evolve(lengths, [], 1024, seed=3)
        assert len(best.fills) < len(start.fills) <= len(fitted.fills)
        assert best.fills.max() <= 1024 and best.fills.sum() == lengths.sum()
    for lengths in (np.full(7, 512), np.array([1, 1023, 1023, 1]), np.array([340, 341, 342, 1])):
        own = packing.completed(lengths, np.arange(len(lengths)), 1024)
        assert sorted(np.concatenate(own).tolist()) == list(range(len(lengths)))
        assert len(own) == -(-lengths.sum() // 1024)
    assert packing.completed(np.array([5]), np.arange(0), 1024) == []


def test_bins_are_completed_by_the_fullest_one_or_two_pieces():
    """Against plain search: the longest piece left, then the one or two that fill most, the longer first piece on ties."""
    random = np.random.default_rng(11)
    for size in (7, 40, 300):
        lengths = random.integers(1, size + 1, 90)
        left, want = sorted(lengths.tolist()), []
        while left:
            own = [left.pop()]
            while True:
                room = size - sum(own)
                single = max((a for a in left if a <= room), default=0)
                pairs = [(a + b, a, b) for i, a in enumerate(left) for j, b in enumerate(left) if i != j and a + b <= room]
                best = max(pairs, default=(0,))
                more = list(best[1:]) if best[0] > single else [single] if single else []
                if not more:
                    break
                for a in more:
                    left.remove(a)
                own += more
            want.append(own)
        got = packing.completed(lengths, np.arange(90), size)
        assert [lengths[members].tolist() for members in got] == want
        assert sorted(np.concatenate(got).tolist()) == list(range(90))
