"""Licence notices against plain matching of word lists."""

from __future__ import annotations

import math
import random
import re

from tests.llm.cases import ODD_TEXTS, SF_LARGER, ascii_lower, documents
from wrenchline.llm.licences import LEAST_SHARE, NOTICES, PHRASES, SLACK, licence_digest, scan_licences
from wrenchline.llm.queries import QUERIES, table


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def base_row(text):
    w = _words(text)
    at = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()]
          for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def notice_places(texts):
    """For each text the (label, start, share) of notices, by trying every start."""
    files = [_words(t) for t in texts]
    out = [[] for _ in texts]
    for notice in NOTICES:
        tw = _words(notice.text)
        idf = {v: math.log((len(files) + 1) / (sum(v in f for f in files) + 1)) for v in tw}
        order = sorted(dict.fromkeys(tw), key=lambda v: -idf[v])
        for k, f in enumerate(files):
            def at(p, f=f):
                return f[p] if 0 <= p < len(f) else None
            roots = set([v for v in order if v in set(f)][:6])
            good = []
            for s in range(-len(tw), len(f)):
                votes = sum(w in roots and at(s + q) == w for q, w in enumerate(tw))
                keyed = votes >= min(3, len(tw)) and all(
                    any(all(at(s + q + d + i) == w for i, w in enumerate(kw)) for d in range(-SLACK, SLACK + 1))
                    for kw in map(_words, notice.keys)
                    for q in [next(q for q in range(len(tw)) if tw[q:q + len(kw)] == kw)])
                share = sum(any(at(s + q + d) == w for d in range(-SLACK, SLACK + 1)) for q, w in enumerate(tw)) / len(tw)
                if keyed and share >= LEAST_SHARE:
                    good.append((s, share))
            while good:
                n = 1
                while n < len(good) and good[n][0] - good[n - 1][0] < len(tw):
                    n += 1
                best = max(good[:n], key=lambda g: (g[1], -g[0]))
                out[k].append((notice.label, best[0], round(best[1], 9)))
                good = good[n:]
    return [sorted(x) for x in out]


def _cases():
    rng = random.Random(2)
    pool = ["the", "software", "license", "of", "version", "tree", "mit", "apache", "2", "0", "cc", "by", "free"]
    texts = list(ODD_TEXTS)
    for notice in NOTICES:
        w = notice.text.split()
        texts.append(" ".join(rng.choices(pool, k=20) + w + rng.choices(pool, k=20)))
        cut = [x for x in w if rng.random() > 0.12]
        texts.append(" ".join(rng.choices(pool, k=3) + cut) + " " + notice.text.upper())
        texts.append(" ".join(w[2:]))
        texts.append(" ".join(w[:len(w) // 2] + ["inserted", "words"] + w[len(w) // 2:]))
    texts += [" ".join(rng.choices(pool, k=300)) for _ in range(20)]
    return texts


def test_notices_and_phrases_against_plain_matching(spark):
    texts = _cases()
    docs = documents(spark, texts).selectExpr("doc_id", "text", "'x' AS found", "7 AS n_words", "'y' AS label")
    rows = {r["doc_id"]: r for r in scan_licences(docs.repartition(4)).collect()}
    want = notice_places(texts)
    for i, text in enumerate(texts):
        found = rows[i]["found"]
        assert sorted((x["label"], x["start"], round(x["share"], 9)) for x in found if not x["whole"]) == want[i], text
        assert len([x for x in found if x["whole"]]) == base_row(text)[1]
    assert sum(map(len, want)) > 60
    digest = {r["doc_id"]: tuple(r)[1:6] for r in licence_digest(scan_licences(docs)).collect()}
    assert digest == {i: base_row(t) for i, t in enumerate(texts)}


def test_whole_table(spark):
    got = QUERIES["op11_rare_token_index"](spark, SF_LARGER)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF_LARGER, "documents").collect()}
    assert {i: tuple(r)[1:6] for i, r in rows.items()} == {i: base_row(t) for i, t in texts.items()}
    for r in rows.values():
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert sum("apache-2.0" in r["labels"] for r in rows.values()) == sum("apache" in r["base_labels"] for r in rows.values())


def test_null_repeated_and_empty(spark):
    docs = documents(spark, [None, "", "mit license mit license", "mit license mit license"]).selectExpr(
        "CASE WHEN doc_id > 1 THEN 5 END AS doc_id", "text")
    rows = sorted((tuple(r) for r in licence_digest(scan_licences(docs)).collect()), key=str)
    assert rows == sorted([(None, 0, 0, None, None, "", "", 0.0)] * 2 + [(5, 4, 2, 0, 2, "mit", "mit", 1.0)] * 2, key=str)
    assert scan_licences(docs.filter("false")).count() == 0
