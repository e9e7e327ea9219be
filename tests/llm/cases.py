"""Small inputs and plain yardsticks for the text operators."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


def documents(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


#: Null, empty, white space, one word, no letters, repeated, very long, other scripts, control characters.
ODD_TEXTS = [None, "", " \n\t ", "word", "12 34 !!", "same text of some words here", "same text of some words here",
             "SAME text OF some words here", "long " * 40_000, "x" * 100_000, "été à l'été\n\n\nNaïve ß", "中文 文字 테스트",
             "a\x00b\x1c\x85c d", "<|endoftext|> in a text", "\n", "one two\nthree four five six\none two"]


def union_of(pairs, nodes) -> dict:
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(texts: dict) -> dict:
    out = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def near_groups(texts: dict) -> tuple[dict, dict]:
    """Set sizes and components of documents by all pairs that share a shingle."""
    sets, lists, links = shingle_sets(texts), defaultdict(list), set()
    for i, own in sets.items():
        shared = defaultdict(int)
        for g in own:
            for j in lists[g]:
                shared[j] += 1
            lists[g].append(i)
        links |= {(j, i) for j, n in shared.items() if 100 * n >= 75 * (len(own) + len(sets[j]) - n)}
    return {i: len(s) for i, s in sets.items()}, union_of(links, sets)


def texts_of(df: DataFrame) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
