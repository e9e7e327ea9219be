"""Versioned parquet folders: ``<path>/v=<n>``, current = highest version whose write completed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def version_path(path: str, version: int) -> str:
    return f"{path}/v={version}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Completed versions, ascending. Spark writes ``_SUCCESS`` last, so it marks a whole version."""
    fs, root = filesystem(spark, path)
    if not fs.exists(root):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(root) if status.isDirectory()]
    numbers = [int(name[2:]) for name in names if name.startswith("v=")]
    done = [n for n in numbers if fs.exists(filesystem(spark, f"{version_path(path, n)}/_SUCCESS")[1])]
    return sorted(done)


def next_version(spark: SparkSession, path: str) -> int:
    done = versions(spark, path)
    return done[-1] + 1 if done else 1


def read_version(spark: SparkSession, path: str, at_most: int | None = None) -> DataFrame | None:
    """The current version, or the newest one not above ``at_most``; None when there is none."""
    done = [v for v in versions(spark, path) if at_most is None or v <= at_most]
    return spark.read.parquet(version_path(path, done[-1])) if done else None


def is_written(spark: SparkSession, path: str, version: int) -> bool:
    """Whether ``version`` is the current one already, as after a repeated micro-batch.

    A newer current version means that the writer does not know the table's history; it must not go on.
    """
    done = versions(spark, path)
    if done and done[-1] > version:
        raise ValueError(f"{path} is at version {done[-1]}, beyond {version}: it belongs to another checkpoint")
    return bool(done) and done[-1] == version


def write_version(df: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write one version; a repeated call for the current version does nothing.

    Older versions beyond the newest ``keep`` are removed once the new one is complete.
    """
    spark = df.sparkSession
    if is_written(spark, path, version):
        return
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true") \
        .parquet(version_path(path, version))
    for old in versions(spark, path)[:-keep]:
        fs, folder = filesystem(spark, version_path(path, old))
        fs.delete(folder, True)


def claim(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Mark ``path`` as the output of the streaming query of ``checkpoint``, or refuse if it is another one's.

    The mark is the query's own id, which Spark keeps in the checkpoint, and is created exclusively. Call it before
    anything is written: versions and batch numbers alone do not tell a repeated micro-batch from a foreign one.
    """
    fs, metadata = filesystem(spark, f"{checkpoint}/metadata")
    with_text = spark._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(metadata)
    try:
        query = json.loads(with_text.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()
    fs, mark = filesystem(spark, f"{path}/_owner")
    if not fs.exists(mark):
        made = fs.create(mark, False)
        try:
            with_text.write(query, made, "UTF-8")
        finally:
            made.close()
    stream = fs.open(mark)
    try:
        owner = with_text.toString(stream, "UTF-8")
    finally:
        stream.close()
    if owner != query:
        raise ValueError(f"{path} belongs to another checkpoint (query {owner}, not {query})")


def start_versions(df: DataFrame, path: str) -> None:
    """Write ``df`` as version 0 of a table that has no version yet."""
    if not versions(df.sparkSession, path):
        write_version(df, path, 0)
