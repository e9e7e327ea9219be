"""A log of changed rows in levels of runs, newest wins.

Every batch adds a run at level 0. ``FAN`` runs of a level are merged into one of the next, so a row is rewritten
once a level and readers find at most ``FAN - 1`` runs a level, however many batches there were. A batch commits its run and
all merges it causes in one manifest; readers of older manifests keep their runs until two later batches are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wrenchline.operators.maintenance import latest_per_key
from wrenchline.sources.manifests import commit_manifest, forget, is_committed, read_manifest, remove_others

FAN = 4
KEEP = 3
#: Column that tells which batch a row comes from.
BATCH = "batch"


def _rows(spark: SparkSession, path: str, runs: Sequence[str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/run/{run}" for run in runs])


def append_run(changed: DataFrame, path: str, batch: int, keys: Sequence[str], fan: int = FAN) -> None:
    """Log the changed rows, at most one per key, of a batch. A repeated batch does nothing."""
    spark = changed.sparkSession
    if is_committed(spark, path, batch + 1):
        return
    current = read_manifest(spark, path)
    levels = [list(level) for level in current[1]["levels"]] if current else []
    marked = changed.withColumn(BATCH, F.lit(batch).cast("bigint"))
    schema = marked.schema

    def add(rows: DataFrame, level: int) -> None:
        run = f"{level}-{batch}"
        rows.write.mode("overwrite").parquet(f"{path}/run/{run}")
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)

    add(marked, 0)
    level = 0
    while len(levels[level]) >= fan:
        rows = _rows(spark, path, levels[level], schema).withColumn("_batch", F.col(BATCH))
        merged = latest_per_key(rows, keys, "_batch")
        add(merged.select(*schema.names), level + 1)
        levels[level] = []
        level += 1
    commit_manifest(spark, path, batch + 1, {"schema": schema.jsonValue(), "levels": levels})
    named = {run for document in forget(spark, path, KEEP) for runs in document["levels"] for run in runs}
    remove_others(spark, f"{path}/run", named)


def run_names(spark: SparkSession, path: str) -> list[str]:
    """The runs a reader has to open."""
    current = read_manifest(spark, path)
    return [run for level in current[1]["levels"] for run in level] if current else []


def read_runs(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row of every key."""
    current = read_manifest(spark, path)
    if current is None:
        raise ValueError(f"{path} has no run")
    schema = StructType.fromJson(current[1]["schema"])
    return latest_per_key(_rows(spark, path, run_names(spark, path), schema), keys, BATCH)
