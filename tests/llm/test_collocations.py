"""Collocations against counting in plain Python, also with fingerprints so narrow that they collide."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from tests.llm.cases import ODD_TEXTS, SF, ascii_lower, documents
from wrenchline.llm.collocations import collocations, frequent_phrases
from wrenchline.llm.queries import ORACLE, QUERIES


def plain(rows, least, top):
    """Rows (lang, text) to the rows of the result."""
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, *w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = {p: n for p, n in count.items() if n >= least}
    out = {}
    for (lang, *w), a in frequent.items():
        if len(w) < 2:
            continue
        inside = any(q[0] == lang and len(q) - 1 > len(w) and b >= a and
                     any(list(q[i:i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, b in frequent.items())
        if not inside:
            cut = min((1000 * a * total[lang] // (frequent[lang, *w[:k]] * frequent[lang, *w[k:]]), k)
                      for k in range(1, len(w)))
            parts = frequent[lang, *w[:cut[1]]], frequent[lang, *w[cut[1]:]]
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), *parts, total[lang]))
    return {(lang, k + 1, p.decode(), -a, le, r, n, -s) for lang, found in out.items()
            for k, (s, a, p, le, r, n) in enumerate(sorted(found)[:top])}


def _texts():
    rng = random.Random(11)
    words = [*"abcdefgh", "Été", "of", "the", "x\x00y", "中文"]
    fixed = ["new York city hall", "of the of the of", "a b c d e f"]
    return [*ODD_TEXTS, *(" ".join(rng.choice([*words, *fixed]) + rng.choice(["", "", "", ",", "\n", "\t ", "!"])
                                   for _ in range(40)) for _ in range(70))]


def _rows(spark):
    docs = documents(spark, _texts()).selectExpr(
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 20 END AS doc_id", "text",
        "CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang", "'q' AS salt", "1 AS n", "'w' AS phrase")
    return docs, [(r["lang"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("bits", [64, 14, 6])
def test_against_counting(spark, bits):
    docs, rows = _rows(spark)
    docs = docs.repartition(3)
    got = [tuple(r) for r in collocations(docs, least=4, top=60, bits=bits).collect()]
    want = plain(rows, 4, 60)
    assert len(want) > 90 and len(got) == len(set(got)) and set(got) == want


def test_repeated_rows_and_empty_tables(spark):
    docs, rows = _rows(spark)
    twice = docs.unionByName(docs).unionByName(docs)
    assert {tuple(r) for r in collocations(twice, least=30, top=25).collect()} == plain(rows * 3, 30, 25)
    assert collocations(docs.filter("false")).count() == 0
    assert collocations(docs.filter("text IS NULL")).count() == 0


def test_exact_beyond_64_bits(spark):
    got = spark.sql("SELECT (1000 * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div "
                    "(CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0))) AS s "
                    "FROM VALUES (99999999999999977L, 99999999999999997L, 99999999999999989L, 99999999999999991L) "
                    "AS t(a, n, l, r)").first()["s"]
    assert got == 1000 * 99999999999999977 * 99999999999999997 // (99999999999999989 * 99999999999999991)


def test_phrases_are_materialised_only_when_frequent(spark):
    docs, rows = _rows(spark)
    phrases, words = frequent_phrases(docs, least=40)
    assert phrases.agg({"n": "min"}).first()[0] >= 40
    assert {r["n"] for r in words.collect()} >= {max(sum(len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t or ""))
                                                        for la, t in rows if la == lang) for lang in ("en", "de"))}


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE["op12_rabin_karp"]).fetchall()
    names = [d[0] for d in con.description]
    got = QUERIES["op12_rabin_karp"](spark, SF).select(*names).collect()
    assert len(want) > 0 and sorted(map(tuple, got)) == sorted(want)
