"""URL filter: rules first; for the rest a multinomial naive Bayes model over the words of host and path.

Names in hosts are often words written together. A unigram model, counted over the text of all pages, splits each
different letter run by Viterbi. The classifier learns from the urls that the rules decide; a short list of unwanted words
counts as some more examples to block. Words, tokens and their counts stay in tables that are joined: nothing is cut
off by its rank, and only a few totals pass the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchline.session import pinned

#: Letters of the longest word of the splitting model.
LONGEST = 24
#: Parts of letter runs handed on at once.
PARTS = 100_000

#: (verdict, rule): the rule's host before its first slash, the path from there.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]

#: Words of hosts and paths that mark advertising, betting, pills, pornography and fraud.
UNWANTED = """ads advert adverts banner popup track tracker tracking bet bets betting casino casinos jackpot poker roulette
slots lottery pills pharmacy viagra cialis adult porn porno sex xxx escort nude spam scam phishing malware warez crack
cracked keygen torrent""".split()
#: Each of them counts in the splitting model like a word of this share of all words, at least, and in the classifier
#: like so many blocked urls that have it in the host, and as many in the path.
UNWANTED_SHARE = 1e-5
UNWANTED_URLS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def decided(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Add ``rule`` and ``ruled`` (its verdict) of the longest rule that fits ``host`` and ``path``, else nulls."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return urls.withColumn("rule", rule).withColumn("ruled", ruled)


def lexicon(pages: DataFrame, unwanted: Sequence[str] = UNWANTED) -> tuple[DataFrame, int]:
    """(word, weight) with the log probability of each word in the text of all pages, and the number of words."""
    text = F.regexp_replace(F.translate(F.coalesce(F.col("html"), F.lit("")), _UPPER, _LOWER),
                            r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"([a-z]+)"), 1)).alias("word"))
    counts = pinned(words.filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    weight = F.log("n") - math.log(max(total["n"] or 0, 1))
    listed = F.col("word").isin(list(unwanted))
    least = F.lit(math.log(UNWANTED_SHARE))
    known = counts.select("word", F.when(listed, F.greatest(weight, least)).otherwise(weight).alias("weight"))
    extra = pages.sparkSession.createDataFrame([(w,) for w in unwanted], "word string").join(counts, "word", "left_anti")
    return known.unionByName(extra.select("word", least.alias("weight"))), total["words"]


def segmented(name: str, words: Mapping[str, float], unknown: float) -> list[str]:
    """The most probable split of a run of letters. A part of k letters that is no known word has the log probability
    ``unknown`` less k times log 10; of equally good splits the one with the longest last parts is taken."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        score, at = -math.inf, 0
        for start in range(max(0, end - LONGEST), end):
            part = name[start:end]
            value = best[start] + words.get(part, unknown - (end - start) * math.log(10))
            if value > score:
                score, at = value, start
        best.append(score)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different parts of each letter run that may be words."""
    runs, words = [], []

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(words, pa.string())], ["id", "word"])
        runs.clear()
        words.clear()
        return made

    for batch in batches:
        for number, run in zip(batch.column("id").to_pylist(), batch.column("run").to_pylist(), strict=True):
            for size in range(1, min(LONGEST, len(run)) + 1):
                found = {run[i:i + size] for i in range(len(run) - size + 1)}
                runs.extend([number] * len(found))
                words.extend(found)
                if len(runs) >= PARTS:
                    yield packed()
    yield packed()


def _splits(unknown: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [segmented(run, {w["word"]: w["weight"] for w in known or ()}, unknown) for run, known in zip(
                batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.string()))], ["id", "words"])

    return split


def split_runs(runs: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(id, words): the split of each letter run (id, run; different ones) by the lexicon ``words``.

    Each run is sent its own parts that are words, so no task holds the lexicon.
    """
    known = runs.mapInArrow(_parts, "id long, word string").join(words, "word").groupBy("id").agg(
        F.collect_list(F.struct("word", "weight")).alias("known"))
    unknown = -math.log(max(n_words, 1)) - 2
    return runs.join(known, "id", "left").mapInArrow(_splits(unknown), "id long, words array<string>")


def url_tokens(urls: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """(row, ruled, token) for every token of ``urls`` (``row``, ``host``, ``path``, ``ruled``).

    Tokens are the words of the letter runs of host and path with the place, ``h:`` or ``p:``, and ``0`` for a number.
    """
    pattern = F.lit(r"([a-z]+|[0-9]+|[^\x00-\x7f]+)")

    def runs(place: str, text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, pattern, 1),
                           lambda run: F.struct(F.lit(place).alias("place"), run.alias("run")))

    both = F.concat(runs("h:", F.col("host")), runs("p:", F.translate("path", _UPPER, _LOWER)))
    found = urls.select("row", "ruled", F.explode(both).alias("r")).select("row", "ruled", "r.*")
    number = F.col("run").rlike("^[0-9]")
    letters = found.filter(~number).withColumn("id", F.xxhash64("run"))
    splits = split_runs(pinned(letters.groupBy("id").agg(F.min("run").alias("run"))), words, n_words)
    worded = letters.drop("run").join(splits, "id").select("row", "ruled", "place", F.explode("words").alias("word"))
    return worded.unionByName(found.filter(number).select("row", "ruled", "place", F.lit("0").alias("word"))).select(
        "row", "ruled", F.concat("place", "word").alias("token"))


def token_odds(tokens: DataFrame, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """(token, odds): log odds of block, by multinomial naive Bayes with one added to each count, from all tokens of
    urls that a rule decided and the unwanted words."""
    listed = [(f"{place}{word}",) for place in ("h:", "p:") for word in unwanted]
    extra = tokens.sparkSession.createDataFrame(listed, "token string").select(
        "token", F.lit(UNWANTED_URLS).cast("long").alias("block"), F.lit(0).cast("long").alias("allow"))
    counts = tokens.filter(F.col("ruled").isNotNull()).groupBy("token").agg(
        F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow"))
    counts = pinned(counts.unionByName(extra).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    total = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n")).first()
    share = [F.log((F.col(side) + 1) / F.lit(float((total[side] or 0) + total["n"]))) for side in ("block", "allow")]
    return counts.select("token", (share[0] - share[1]).alias("odds"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the model's probability of
    block, also where a rule decides).

    The verdict is the rule's, else block for a score above one half. A null url, or one without ``://``, has an empty
    host and path, fits no rule and has the score of the verdicts' shares, as has a url of unseen words. Rows are judged
    one by one, so repeated rows stay; an empty table gives no rows; other columns are ignored; a null ``html`` has no
    words.
    """
    host, path = host_and_path(F.col("url"))
    urls = pinned(decided(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
                  .withColumn("row", F.monotonically_increasing_id()))
    words, n_words = lexicon(pages)
    tokens = pinned(url_tokens(urls, words, n_words))
    shares = urls.agg(*[F.count_if(F.col("ruled") == v).alias(v) for v in ("block", "allow")]).first()
    prior = math.log((shares["block"] + 1) / (shares["allow"] + 1))
    sums = tokens.join(token_odds(tokens), "token").groupBy("row").agg(F.sum("odds").alias("odds"))
    odds = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.lit(prior) + F.coalesce("odds", F.lit(0.0))))
    scored = urls.join(sums, "row", "left").withColumn("score", 1 / (1 + F.exp(-odds)))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
