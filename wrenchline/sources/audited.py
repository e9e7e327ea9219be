"""Loading with audits in the same pass: the job that writes the rows also counts rejects and broken row rules.

Counts are ``Observation`` metrics. A load lays its rows under ``<path>/rejected=false``, its rejects, as raw text with
their ``problem``, under ``<path>/rejected=true``, both from one read of the raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wrenchline.operators.integrity import row_test
from wrenchline.schemas import Rule
from wrenchline.sources.tables import marked_rows
from wrenchline.sources.versions import claim
from wrenchline.streaming.streams import each_batch

REPORT = "rule string, violations bigint"


def _measured(raw: DataFrame, schema: T.StructType, rules: Sequence[Rule], **how) -> tuple[DataFrame, dict[str, Column]]:
    """(rows to write, what to count on them). Row rules are tested on the rows that are accepted."""
    marked = marked_rows(raw, schema, **how)
    good = F.col("problem") == ""
    counts = {"rows": F.count("*"), "rejected": F.count_if(~good)}
    for rule in rules:
        inside = replace(rule, columns=tuple(f"typed.{c}" for c in rule.columns))
        counts[rule.name] = F.count_if(good & row_test(marked, inside))
    return marked, counts


def _write(marked: DataFrame, counts: Mapping[str, Column], path: str, mode: str) -> dict[str, int]:
    seen = Observation()
    named = [value.alias(f"m{i}") for i, value in enumerate(counts.values())]
    rejected = F.col("problem") != ""
    raw = F.when(rejected, F.to_json("raw")).alias("raw")
    (marked.observe(seen, *named)
     .select(F.when(~rejected, F.col("typed")).alias("typed"), raw, "problem", rejected.alias("rejected"))
     .write.mode(mode).partitionBy("rejected").parquet(path))
    found = seen.get
    return {name: found[f"m{i}"] for i, name in enumerate(counts)}


def load_audited(raw: DataFrame, schema: T.StructType, path: str, rules: Sequence[Rule] = (), **how) -> DataFrame:
    """Write the typed rows and the rejects of ``raw`` to ``path`` and return (rule, violations): ``rows``,
    ``rejected`` and each row rule (not null, enum, length, range), counted by the write itself.

    ``how`` is as in ``ingest_rows``. An existing load at ``path`` is replaced. Read it by ``accepted`` and ``rejects``.
    """
    marked, counts = _measured(raw, schema, rules, **how)
    found = _write(marked, counts, path, "overwrite")
    return raw.sparkSession.createDataFrame(list(found.items()), REPORT)


def stream_audited(raw: DataFrame, schema: T.StructType, path: str, checkpoint: str, rules: Sequence[Rule] = (),
                   **how) -> StreamingQuery:
    """``load_audited`` of a stream: micro-batch n is the load ``<path>/rows/batch=n``, its counts are
    ``<path>/counts/batch=n``. A repeated micro-batch writes both again, so nothing counts twice."""
    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, path, checkpoint)
        found = load_audited(batch, schema, f"{path}/rows/batch={batch_id}", rules, **how)
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return each_batch(raw, load, checkpoint)


def accepted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The typed rows of a load, or of all loads of a stream (``<path>/rows``)."""
    return _stored(spark, path, schema).filter("NOT rejected").select("typed.*")


def rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(raw, problem): the raw row as JSON text and what is wrong with it."""
    return _stored(spark, path, schema).filter("rejected").select("raw", "problem")


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType([T.StructField("typed", schema), T.StructField("raw", T.StringType()),
                           T.StructField("problem", T.StringType()), T.StructField("rejected", T.BooleanType())])
    return spark.read.schema(stored).parquet(path)


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """(rule, violations) over all micro-batches of ``stream_audited``."""
    return spark.read.parquet(f"{path}/counts").groupBy("rule").agg(F.sum("violations").alias("violations"))
