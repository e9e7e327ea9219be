"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchline.llm.collocations import collocations
from wrenchline.llm.decontamination import contamination
from wrenchline.llm.language import languages, train_languages
from wrenchline.llm.licences import licence_digest, scan_licences
from wrenchline.llm.minhash import near_duplicates
from wrenchline.llm.offsets import section_tokens
from wrenchline.llm.packing import pack
from wrenchline.llm.pivots import near_vectors
from wrenchline.llm.quality import quality_scores, train_quality
from wrenchline.llm.resampling import resample
from wrenchline.llm.shared import fold
from wrenchline.llm.templates import without_recurring_lines
from wrenchline.llm.toxicity import predicted, toxicity_scores, train_toxicity
from wrenchline.llm.urls import judge_urls

TOXIC_LEAST = 0.7
QUALITY_LEAST = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = train_toxicity(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", predicted("score", TOXIC_LEAST))


def op2_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op3_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = train_languages(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_recurring_lines(table(spark, sf_dir, "documents"), counts=True)


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = train_quality(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return quality_scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", predicted("score", QUALITY_LEAST))


def op7_host_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digest(scan_licences(table(spark, sf_dir, "documents")))


def op12_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ftrl_toxicity": op1_ftrl_toxicity,
    "op2_fm_index": op2_fm_index,
    "op3_marginal_unigrams": op3_marginal_unigrams,
    "op4_pivot_permutations": op4_pivot_permutations,
    "op5_template_tree": op5_template_tree,
    "op6_subword_quality": op6_subword_quality,
    "op7_host_segmentation": op7_host_segmentation,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op9_offset_attribution": op9_offset_attribution,
    "op10_grouping_genetic": op10_grouping_genetic,
    "op11_rare_token_index": op11_rare_token_index,
    "op12_rabin_karp": op12_rabin_karp,
    "op13_radix_resampling": op13_radix_resampling,
}

#: Text in which A-Z are lower-cased, and its words.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op2_fm_index": f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (
            SELECT item_id, w[i:i + least(10, len(w)) - 1] AS x
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
                  FROM b WHERE len(w) > 0))),
        sizes AS (SELECT DISTINCT n FROM win),
        runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (
            SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        occ AS (SELECT doc_id, n, i, item_id FROM runs JOIN win USING (n, x)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    "op12_rabin_karp": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph FROM (
            SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY lang, k, ph HAVING count(*) >= 100),
        cut AS (SELECT lang, ph, f AS a, c, array_to_string(string_split(ph, ' ')[1:c], ' ') AS le,
                       array_to_string(string_split(ph, ' ')[c + 1:], ' ') AS ri FROM f, range(1, 5) t(c) WHERE c < k),
        scored AS (SELECT cut.lang, cut.ph, a, c, x.f AS l, y.f AS r, n,
                          CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
                   FROM cut JOIN f x ON x.lang = cut.lang AND x.ph = le JOIN f y ON y.lang = cut.lang AND y.ph = ri
                   JOIN total ON total.lang = cut.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, c) = 1),
        inner_part AS (SELECT lang, array_to_string(string_split(ph, ' ')[i:i + m - 1], ' ') AS ph, f
                       FROM f, range(2, 5) t(m), range(1, 6) u(i) WHERE m < k AND i + m - 1 <= k),
        cover AS (SELECT lang, ph, max(f) AS cover FROM inner_part GROUP BY lang, ph)
        SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.ph) AS rank,
               best.ph AS phrase, a, l, r, n, score
        FROM best LEFT JOIN cover ON cover.lang = best.lang AND cover.ph = best.ph
        WHERE cover IS NULL OR 100 * cover < 100 * a
        QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.ph) <= 2000""",
}
