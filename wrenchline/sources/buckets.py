"""Tables in hash buckets with copy on write: a version lists one folder per bucket, and an update writes only the
buckets it touches. Readers may ask for some buckets only.

``<path>/data/v=<n>/bucket=<b>`` holds the rows of bucket b as of version n; the manifest maps each bucket to the
version that wrote it last, with its row count and the range of one numeric column (the zone), by which whole
buckets can be passed over. Files that an interrupted writer left are named by no manifest and are overwritten.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from wrenchline.sources.manifests import (
    commit_manifest, forget, is_committed, numbers, read_manifest, remove_others,
)

KEEP = 3


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Buckets:
    """A bucketed table at a path. ``zone`` names the numeric column of which each bucket keeps the range."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    zone: str | None = None

    def create(self, df: DataFrame) -> None:
        """Write version 0 of a table that has no version yet."""
        if not numbers(self.spark, self.path):
            self._write(df, 0, None)

    def is_written(self, version: int) -> bool:
        return is_committed(self.spark, self.path, version)

    def _manifest(self, at_most: int | None = None) -> dict:
        known = [n for n in numbers(self.spark, self.path) if at_most is None or n <= at_most]
        if not known:
            raise ValueError(f"{self.path} has no version")
        return read_manifest(self.spark, self.path, known[-1])[1]

    def read(self, only: Collection[int] | None = None, at_most: int | None = None) -> DataFrame:
        """The rows, or those of some buckets, of the current version or of the newest not above ``at_most``."""
        manifest = self._manifest(at_most)
        folders = [f"{self.path}/data/v={entry['v']}/bucket={b}" for b, entry in manifest["buckets"].items()
                   if only is None or int(b) in only]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def touched(self, changes: DataFrame) -> set[int]:
        """Numbers of the buckets that the keys of ``changes`` fall into."""
        return {row["b"] for row in changes.select(bucket_of(self.keys, self.buckets).alias("b")).distinct().collect()}

    def within_zone(self, value: float) -> set[int]:
        """Buckets whose zone column may have ``value``."""
        return {int(b) for b, entry in self._manifest()["buckets"].items()
                if entry["low"] is not None and entry["low"] <= value <= entry["high"]}

    def update(self, version: int, touched: set[int], change: Callable[[DataFrame], DataFrame]) -> int:
        """Version ``version`` from the one before: ``change`` maps the rows of the touched buckets to their new rows.

        Returns the number of buckets written. Without a touched bucket nothing is written and the version before
        stays current. A repeated call for the current version does nothing.
        """
        if self.is_written(version) or not touched:
            return 0
        return self._write(change(self.read(touched, version - 1)), version, touched)

    def _write(self, rows: DataFrame, version: int, touched: set[int] | None) -> int:
        folder = f"{self.path}/data/v={version}"
        if "bucket" in (c.lower() for c in rows.columns):
            raise ValueError("a bucketed table has no column named bucket")
        (rows.withColumn("bucket", bucket_of(self.keys, self.buckets)).repartition("bucket")
         .sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(folder))
        zone = F.col(self.zone) if self.zone else F.lit(None).cast("int")
        stored = StructType([*rows.schema, StructField("bucket", IntegerType())])
        written = self.spark.read.schema(stored).parquet(folder).groupBy("bucket").agg(
            F.count("*").alias("n"), F.min(zone).cast("double").alias("low"), F.max(zone).cast("double").alias("high"))
        found = {str(r["bucket"]): {"v": version, "rows": r["n"], "low": r["low"], "high": r["high"]}
                 for r in written.collect()}
        if not found.keys() <= {str(b) for b in touched or range(self.buckets)}:
            raise ValueError(f"{self.path}: a row left the buckets that were touched")
        old = {} if touched is None else {b: e for b, e in self._manifest(version - 1)["buckets"].items()
                                          if int(b) not in touched}
        commit_manifest(self.spark, self.path, version,
                        {"schema": rows.schema.jsonValue(), "buckets": {**old, **found}})
        self._vacuum()
        return len(found)

    def _vacuum(self) -> None:
        """Remove versions and single buckets that the newest manifests do not name."""
        kept = forget(self.spark, self.path, KEEP)
        named: dict[str, set[str]] = {}
        for document in kept:
            for b, entry in document["buckets"].items():
                named.setdefault(f"v={entry['v']}", set()).add(f"bucket={b}")
        remove_others(self.spark, f"{self.path}/data", set(named))
        for version, folders in named.items():
            remove_others(self.spark, f"{self.path}/data/{version}", folders)
