from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.cases import ODD_TEXTS, SF_LARGER, ascii_lower, documents, texts_of
from wrenchline.llm import templates
from wrenchline.llm.minhash import _SHINGLE_FACTORS
from wrenchline.llm.queries import QUERIES
from wrenchline.llm.templates import without_recurring_lines
from wrenchline.llm.textbytes import NOT_SPACE, chunks, mix, span_hashes, words


def parse(line):
    """(leaf, the values of the fields that the line has, whether it can have a template)."""
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in tokens_of(line)]
    fields = [()] * min(max(len(tokens) - 3, 0), 8)
    for place, token in enumerate(tokens[3:]):
        fields[place * 8 // max(len(tokens) - 3, 8)] += (token,)
    return (len(tokens), tuple(tokens[:3])), tuple(fields), len(tokens) >= 3


def tokens_of(line):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(line))


class Text:
    """Words, the line of each, hashes of all shingles (the operator's, as minima depend on their order)."""

    def __init__(self, text):
        (chunk,) = chunks(pa.array([text]))
        self.lines = text.split("\n")
        self.words = [(word, k) for k, line in enumerate(self.lines) for word in tokens_of(line)]
        self.shingles = [self.words[i:i + 5] for i in range(len(self.words) - 4)]
        found = words(chunk, NOT_SPACE).hashes
        self.hashes = [int(mix((found[i:i + 5] * _SHINGLE_FACTORS).sum(keepdims=True))[0]) for i in range(len(found) - 4)]
        self.order = int(span_hashes(chunk.data, chunk.offsets[:-1], chunk.offsets[1:]).view(np.int64)[0])

    def minima(self, own):
        """The 8 minima outside the lines ``own``; all 0 if nothing is outside or the lines make the text a near copy."""
        inside = sum(all(k in own for _, k in shingle) for shingle in self.shingles)
        if inside and 100 * inside >= 75 * (2 * len(self.shingles) - inside):
            return [0] * 8
        outside = [h for h, shingle in zip(self.hashes, self.shingles, strict=True) if not any(k in own for _, k in shingle)]
        if outside:
            return [min((h * int(f)) % 2**64 for h in outside) for f in templates._CONTEXT_FACTORS]
        rest = tuple(word for word, k in self.words if k not in own)
        return [rest or 0] * 8


def brute(texts: dict) -> dict:
    """The lines that go, by document, from whole token lists in place of hashes."""
    docs_of = defaultdict(set)
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            leaf, fields, counts = parse(line)
            if counts:
                docs_of[leaf, fields].add(doc)
    kinds, support = defaultdict(list), defaultdict(int)
    for (leaf, fields), docs in docs_of.items():
        kinds[leaf].append(fields)
        for k, value in enumerate(fields):
            support[leaf, k, value] += len(docs)
    template_of = {}
    for leaf, own in kinds.items():
        for fields in own:
            template_of[leaf, fields] = (leaf, fields)
            if len(own) > 1 and sum(len(docs_of[leaf, f]) for f in own) >= 3:
                kept = {(k, v) for k, v in enumerate(fields) if support[leaf, k, v] >= 3}
                if kept and len(kept) >= 0.75 * len(fields):
                    template_of[leaf, fields] = (leaf, frozenset(kept))
    texts_with = defaultdict(set)
    for kind, docs in docs_of.items():
        texts_with[template_of[kind]] |= {ascii_lower(texts[d]) for d in docs}
    known, recurring = {}, set()
    for template, own in texts_with.items():
        if len(own) < 3:
            continue
        # Each value is the first text's that has it; a text of which all values are its own is a source.
        values, sources = set(), 0
        for text in sorted((known.setdefault(t, Text(t)) for t in own), key=lambda t: t.order):
            gone = {k for k, line in enumerate(text.lines)
                    if parse(line)[2] and template_of[parse(line)[:2]] == template}
            found = set(enumerate(text.minima(gone)))
            sources += not found & values
            values |= found
        if sources >= 3 or len(values) / 8 - 1 >= 0.4 * (len(own) - 1):
            recurring.add(template)
    return {doc: [line for line in (text or "").split("\n") if parse(line)[2] and template_of[parse(line)[:2]] in recurring]
            for doc, text in texts.items()}


def check(rows, texts):
    want = brute(texts)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        before = (texts[r["doc_id"]] or "").split("\n")
        gone = want[r["doc_id"]]
        assert r["n_dropped"] == len(gone), (r["doc_id"], gone)
        if gone:
            assert r["text"].rstrip("\n") == "\n".join(x for x in before if x not in gone).rstrip("\n")
        else:
            assert r["text"] == texts[r["doc_id"]]


def test_query_against_token_lists(spark):
    texts = texts_of(spark.read.parquet(f"{SF_LARGER}/documents.parquet"))
    rows = QUERIES["op5_template_tree"](spark, SF_LARGER).collect()
    check(rows, texts)
    assert sum(r["n_dropped"] for r in rows) > 100


def prose(n):
    return " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(n))


def cases():
    random.seed(9)
    passage = prose(60)
    copied, group = prose(80) + "\n" + prose(70), [prose(90), prose(40), prose(50)]
    near = []
    for _ in range(12):
        words = [p.split() for p in group]
        for own in words:
            for k in random.sample(range(len(own)), 1):
                own[k] = "edited" + random.choice("xyz")
        near.append("\n".join(" ".join(own) for own in words))
    names = ["Ann", "Bo", "Cy", "Di", "Ed"]
    return [*ODD_TEXTS,
            *(f"{prose(30)}\n{passage}\n{prose(20)}" for _ in range(6)), passage,
            *([copied] * 7), *near,
            *(f"{prose(25)}\nposted on day {k} of 2024 by user nr {k * 7}\n{prose(9)}" for k in range(5)),
            *(f"{prose(25)}\nthis fine page was written with much love by {n} for all of you out there\n\n" for n in names),
            *(prose(30) for _ in range(5))]


def test_variable_fields_passages_and_copies(spark):
    texts = cases()
    docs = documents(spark, texts)
    by_id = texts_of(docs)
    rows = without_recurring_lines(docs.withColumn("kinds", F.lit(1)), counts=True).collect()
    check(rows, by_id)
    dropped = [r["n_dropped"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    at = len(ODD_TEXTS)
    assert dropped[at:at + 7] == [1] * 7  # the passage
    assert dropped[at + 7:at + 26] == [0] * 19  # copies and near copies keep their lines
    assert dropped[at + 26:at + 36] == [1] * 10  # numbers and names vary
    assert dropped[at + 36:] == [0] * 5


def test_documents_keep_columns_and_emptied_ones_go(spark):
    texts = cases()
    docs = documents(spark, texts).withColumn("KINDS", F.lit("x"))
    kept = without_recurring_lines(docs)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(range(len(texts))) - {len(ODD_TEXTS) + 6}
    assert without_recurring_lines(docs.limit(0)).count() == 0
    nameless = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert without_recurring_lines(nameless).count() == 3


def dropped_of(spark, texts):
    docs = documents(spark, texts)
    rows = without_recurring_lines(docs, counts=True).collect()
    check(rows, texts_of(docs))
    return [r["n_dropped"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_passages_longer_than_the_rest_and_many_copies_of_one_source(spark):
    random.seed(12)
    passage, line, sources = prose(60), prose(12), [prose(40) for _ in range(4)]
    long = [f"{prose(10)}\n{passage}\n{prose(15)}" for _ in range(30)]
    few = [f"{text}\n{line}" for text in sources]
    near = []
    for k in range(40):
        words = sources[0].split()
        words[k] = "edited"
        near.append(f"{' '.join(words)}\n{line}")
    copied = prose(50)
    alike = [f"{copied}\n{prose(1)}" for _ in range(30)]
    assert dropped_of(spark, [*long, *few, *near, *alike]) == [1] * 74 + [0] * 30


def test_short_lines_with_different_words_stay(spark):
    random.seed(13)
    four = [f"{prose(20)}\nthor the haan {prose(1)}." for _ in range(6)]
    five = [f"{prose(20)}\nposted by the {prose(2)}" for _ in range(6)]
    seven = [f"{prose(20)}\nsee all posts by {prose(1)} right here" for _ in range(6)]
    same = [f"{prose(20)}\nback to the top" for _ in range(6)]
    assert dropped_of(spark, [*four, *five, *seven, *same]) == [0] * 12 + [1] * 12


def test_texts_are_shuffled_once_for_both_joins(spark, tmp_path):
    line = "this very line is found in every text of the table"
    rows = [(k, f"{line}\n" + " ".join(f"w{k}x{i}" for i in range(30))) for k in range(40)] + [(None, line), (None, None), (50, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = without_recurring_lines(spark.read.parquet(f"{tmp_path}/documents"), counts=True)
        got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(k, text.split("\n")[1], 2, 1) for k, text in rows[:40]} | {(None, line, 1, 0), (None, None, 0, 0), (50, None, 0, 0)} == got
    assert "ReusedExchange [doc_id" in plan
