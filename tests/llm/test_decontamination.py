from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ODD_TEXTS, ascii_lower, documents, texts_of
from wrenchline.llm.decontamination import contamination, decontaminate
from wrenchline.llm.fmindex import FMIndex, suffix_array


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def brute(texts: dict, items: dict) -> dict:
    windows = {}
    for item, text in items.items():
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = {}
    for doc, text in texts.items():
        w, hit, found = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def cases(spark):
    random.seed(5)
    vocabulary = ["an", "be", "Cé", "do", "7", "ex", "fo"]
    texts = [*ODD_TEXTS, *(" ".join(random.choices(vocabulary[:3], k=k)) for k in (3, 40, 200)),
             *(" ".join(random.choices(vocabulary, k=k)) for k in (9, 50, 300)), "be, be; be. an-an cé"]
    items = {1: "an be cé", 2: "be be be be be be be be be be be be", 3: None, 4: "", 5: " ".join(vocabulary[:3] * 5),
             6: "be", 7: "word", 8: "nowhere at all", 9: " ".join(random.choices(vocabulary[:3], k=12)), 10: "an be cé"}
    docs = documents(spark, texts)
    return docs, spark.createDataFrame(list(items.items()), "item_id long, text string"), items


@pytest.mark.parametrize("block_rows, shard_words", [(200_000, 1 << 20), (7, 50)])
def test_contamination_against_all_windows(spark, block_rows, shard_words):
    docs, bench, items = cases(spark)
    want = brute(texts_of(docs), items)
    got = contamination(docs.withColumn("spans", F.lit(1)), bench, shard_words=shard_words, block_rows=block_rows)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        n_hit = sum(s["words"] for s in r["spans"])
        assert (r["n_words"], n_hit, list(r["items"])) == want[r["doc_id"]]
        ends = [(s["word"], s["word"] + s["words"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_hit_words_are_cut_out(spark, block_rows):
    docs, bench, items = cases(spark)
    before = texts_of(docs)
    got = decontaminate(docs.withColumn("_n", F.lit(4)), bench, block_rows=block_rows)
    assert got.columns == [*docs.columns, "_n"]
    after = texts_of(got)
    assert after.keys() == before.keys()
    for doc, (n, n_hit, _) in brute(before, items).items():
        assert len(words_of(after[doc])) == n - n_hit
        if not n_hit:
            assert after[doc] == before[doc]


def test_empty_tables(spark):
    docs, bench, _ = cases(spark)
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_index_finds_every_occurrence():
    random_numbers = np.random.default_rng(2)
    for symbols, n in ((2, 300), (5, 200), (40, 400)):
        text = random_numbers.integers(0, symbols, n)
        text[-1] = 0
        order = suffix_array(text)
        assert sorted(order.tolist()) == list(range(n))
        index = FMIndex(text, symbols)
        for k in range(1, 6):
            patterns = random_numbers.integers(1, symbols, (20, k)) if symbols > 2 else np.ones((1, k), np.int64)
            which, low, high = index.search(patterns, np.full(len(patterns), k))
            found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
            for p, pattern in enumerate(patterns):
                at = [i for i in range(n - k + 1) if (text[i:i + k] == pattern).all()]
                assert found.get(p, []) == at


@pytest.mark.parametrize("block_rows", [200_000, 1])
def test_repeated_and_null_ids(spark, block_rows):
    texts = ["é one two three here", "one two three", "rest of éé four five six", "nothing", None, "four five six one two three"]
    rows = [(i, t) for i in (None, 1, 2) for t in texts] + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "item_id long, text string")
    want = {texts[0]: "é here", texts[1]: "", texts[2]: "rest of éé", texts[5]: ""}
    got = decontaminate(docs, bench, block_rows=block_rows).collect()
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=i, text=want.get(t, t))) for i, t in rows)
    found = contamination(docs, bench, block_rows=block_rows).collect()
    items = {0: ["1"], 1: ["1"], 2: ["2"], 5: ["1", "2"]}
    assert sorted((str(r["doc_id"]), list(r["items"])) for r in found) == sorted(
        (str(i), items.get(texts.index(t), [])) for i, t in rows)
