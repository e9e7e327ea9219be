"""The revenue and usage reports kept up to date from signed changes of order lines and catalogue rows.

A change is a row with a weight: +1 for one that comes, -1 for one that goes; an update is both. Lines and catalogue rows are
kept as counts in hash-bucketed tables (``sources.buckets``), by part for the revenue and by name for the usage. A micro-batch
opens the buckets of its parts and names, works out what each contributed before and contributes now, and adds the
difference to the totals; so removals are right, and the work follows the changes. All but the totals' first
part per supplier can be told from the difference: where that part went, the supplier's parts are read again.

Micro-batch n makes version n + 1 of each table it touches, from the versions before, so a repeated one completes what
an interrupted one left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wrenchline.operators.reports import first_version
from wrenchline.operators.stock import by_number
from wrenchline.session import pinned
from wrenchline.sources.buckets import Buckets
from wrenchline.sources.manifests import numbers
from wrenchline.sources.versions import claim
from wrenchline.streaming.streams import each_batch

LINE = ["part_code", "name"]
CATALOG = ["part_code", "version", "name", "category", "brand", "price", "supplier"]
#: Which rows a change concerns.
LINES, ENTRIES = "lines", "catalog"
_SUMS = {"revenue": ["revenue", "lines_sold", "parts"], "usage": ["used", "total"]}


@dataclass(frozen=True)
class ReportViews:
    """The tables of both reports below a path."""

    spark: SparkSession
    path: str
    buckets: int

    def table(self, name: str, key: str) -> Buckets:
        return Buckets(self.spark, f"{self.path}/{name}", (key,), self.buckets)

    @property
    def sold(self) -> Buckets:
        return self.table("sold", "part_code")

    @property
    def entries(self) -> Buckets:
        return self.table("entries", "part_code")

    @property
    def written(self) -> Buckets:
        return self.table("written", "name")

    @property
    def named(self) -> Buckets:
        return self.table("named", "name")

    @property
    def revenue(self) -> Buckets:
        return self.table("revenue", "supplier")

    @property
    def usage(self) -> Buckets:
        return self.table("usage", "category")

    def create(self, lines: DataFrame, catalog: DataFrame) -> None:
        """Write the first versions, each once, from the tables as they are."""
        if numbers(self.spark, self.usage.path):  # the last one is there, so all are
            return
        counted = pinned(_counted(lines.withColumn("weight", F.lit(1)), LINE)).withColumnRenamed("n", "weight")
        self.sold.create(_counted(counted, ["part_code"]))
        self.written.create(_counted(counted, ["name"]))
        rows = catalog.select(*CATALOG).withColumn("price", F.col("price").cast("decimal(18,2)")).withColumn("weight", F.lit(1))
        self.entries.create(_counted(rows, ["part_code", "version", "brand", "price", "supplier"]))
        self.named.create(_counted(rows, ["name", "part_code", "version", "category"]))
        sales = _sales(self.entries.read(), self.sold.read())
        self.revenue.create(sales.groupBy("supplier").agg(*_sale_sums(F.lit(1)), F.min("first").alias("first")))
        self.usage.create(_uses(self.named.read(), self.written.read()).groupBy("category").agg(*_use_sums(F.lit(1))))


def _counted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each row is there; those that are there no more are left out."""
    return rows.groupBy(*columns).agg(F.sum(F.col("weight").cast("bigint")).alias("n")).filter("n <> 0")


def _sales(entries: DataFrame, sold: DataFrame) -> DataFrame:
    """One row per part that is in the catalogue and sold: supplier, what it brought, and its rank among parts."""
    priced = entries.filter("n > 0").groupBy("part_code").agg(
        F.min_by(F.struct("supplier", "brand", "price"), "version").alias("_row")).select("part_code", "_row.*")
    return sold.filter("n > 0").join(priced, "part_code").select(
        "part_code", "supplier", "price", "n", F.struct(by_number("part_code").alias("rank"), "brand").alias("first"))


def _sale_sums(sign: Column) -> list[Column]:
    return [F.sum(sign * F.col("price") * F.col("n")).cast("decimal(38,2)").alias("revenue"),
            F.sum(sign * F.col("n")).alias("lines_sold"), F.sum(sign).cast("bigint").alias("parts")]


def _uses(named: DataFrame, written: DataFrame) -> DataFrame:
    """One row per name of the catalogue: the category of its first row, and whether a line has it."""
    names = named.filter("n > 0").groupBy("name").agg(F.min_by("category", F.struct(*first_version())).alias("category"))
    used = written.filter("n > 0").select("name", F.lit(True).alias("used"))
    return names.join(used, "name", "left").select("category", F.coalesce("used", F.lit(False)).cast("int").alias("used"))


def _use_sums(sign: Column) -> list[Column]:
    return [F.sum(sign * F.col("used")).cast("bigint").alias("used"), F.sum(sign).cast("bigint").alias("total")]


def stream_report_views(changes: DataFrame, lines: DataFrame, catalog: DataFrame, path: str, checkpoint: str,
                        buckets: int = 64) -> StreamingQuery:
    """Both reports below ``path``, from tables as they are at first and a stream of changes.

    ``changes`` has ``changed`` ("lines" or "catalog"), ``weight`` and the columns of catalogue rows; of a line the part
    and the name are read. A row may go before it comes: its count is negative until then and it is not there.
    Rows of no weight change nothing. Read the reports with ``revenue_report`` and ``usage_report``.
    """
    views = ReportViews(changes.sparkSession, path, buckets)
    views.create(lines, catalog)

    def apply(batch: DataFrame, batch_id: int) -> None:
        claim(views.spark, path, checkpoint)
        rows = batch.select("changed", "weight", *CATALOG).withColumn("price", F.col("price").cast("decimal(18,2)"))
        # Equal changes count once from here on, and those that cancel out not at all.
        batch = pinned(_counted(rows, ["changed", *CATALOG]).withColumnRenamed("n", "weight"))
        if not batch.isEmpty():
            _revenue_changes(views, batch, batch_id + 1)
            _usage_changes(views, batch, batch_id + 1)

    return each_batch(changes, apply, checkpoint)


def _step(table: Buckets, changes: DataFrame, keys: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Change the counts of a table by ``changes``; the rows of ``keys`` (one column, distinct) before and after."""
    key, columns = keys.columns[0], [c for c in changes.columns if c != "weight"]
    touched = table.touched(keys)
    old = table.read(touched, version - 1)

    table.update(version, table.touched(changes), lambda rows: _counted(
        rows.withColumnRenamed("n", "weight").unionByName(changes), columns))

    def of_keys(rows: DataFrame) -> DataFrame:
        other = keys.toDF("_key")
        return rows.join(other, rows[key].eqNullSafe(other["_key"]), "left_semi")

    return of_keys(old), of_keys(table.read(touched, version))


def _moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """What went (``sign`` -1) and what came (+1)."""
    return pinned(before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1))))


def _revenue_changes(views: ReportViews, batch: DataFrame, version: int) -> None:
    keys = pinned(batch.select("part_code").distinct())
    lines, entries = batch.filter(F.col("changed") == LINES), batch.filter(F.col("changed") == ENTRIES)
    sold = _step(views.sold, lines.select("part_code", "weight"), keys, version)
    rows = _step(views.entries, entries.select("part_code", "version", "brand", "price", "supplier", "weight"), keys, version)
    moved = _moved(_sales(rows[0], sold[0]), _sales(rows[1], sold[1]))
    delta = pinned(moved.groupBy("supplier").agg(
        *_sale_sums(F.col("sign")), F.min(F.when(F.col("sign") < 0, F.col("first"))).alias("gone"),
        F.min(F.when(F.col("sign") > 0, F.col("first"))).alias("come")).filter(
        "revenue <> 0 OR lines_sold <> 0 OR parts <> 0 OR NOT gone <=> come"))
    touched = views.revenue.touched(delta)
    unknown = F.lit(None).cast(delta.schema["come"].dataType)
    old = views.revenue.read(touched, version - 1).select(
        "supplier", *_SUMS["revenue"], "first", unknown.alias("gone"), unknown.alias("come"))
    both = old.unionByName(delta.select("supplier", *_SUMS["revenue"], unknown.alias("first"), "gone", "come"))
    total = both.groupBy("supplier").agg(
        *[F.sum(c).cast(old.schema[c].dataType).alias(c) for c in _SUMS["revenue"]],
        *[F.min(c).alias(c) for c in ("first", "gone", "come")]).filter(F.col("parts") > 0)
    left = F.coalesce(F.col("gone.rank") == F.col("first.rank"), F.lit(False))
    # The first part went, and what came is behind it: a part that did not change may be the first now.
    unsure = left & F.coalesce(F.col("come.rank") > F.col("first.rank"), F.lit(True))
    known = F.when(left, F.col("come")).otherwise(F.least("first", "come"))
    total = pinned(total.select("supplier", *_SUMS["revenue"], known.alias("first"), unsure.alias("unsure")))
    again = total.filter("unsure").select(F.col("supplier").alias("_supplier"))
    settled = total.drop("unsure")
    if not again.isEmpty():
        sales = _sales(views.entries.read(at_most=version), views.sold.read(at_most=version))
        firsts = sales.join(again, F.col("supplier").eqNullSafe(F.col("_supplier")), "left_semi").groupBy(
            F.col("supplier").alias("_supplier")).agg(F.min("first").alias("_first"))
        settled = settled.join(firsts, F.col("supplier").eqNullSafe(F.col("_supplier")), "left").select(
            "supplier", *_SUMS["revenue"], F.coalesce("_first", "first").alias("first"))
    views.revenue.update(version, touched, lambda rows: settled)


def _usage_changes(views: ReportViews, batch: DataFrame, version: int) -> None:
    keys = pinned(batch.select("name").distinct())
    lines, entries = batch.filter(F.col("changed") == LINES), batch.filter(F.col("changed") == ENTRIES)
    written = _step(views.written, lines.select("name", "weight"), keys, version)
    named = _step(views.named, entries.select("name", "part_code", "version", "category", "weight"), keys, version)
    moved = _moved(_uses(named[0], written[0]), _uses(named[1], written[1]))
    delta = pinned(moved.groupBy("category").agg(*_use_sums(F.col("sign"))).filter("used <> 0 OR total <> 0"))
    sums = _SUMS["usage"]
    views.usage.update(version, views.usage.touched(delta), lambda rows: rows.unionByName(delta).groupBy("category").agg(
        *[F.sum(c).alias(c) for c in sums]).filter("total > 0"))


def revenue_report(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """As ``reports.supplier_revenue`` of the lines and the catalogue after all changes."""
    rows = ReportViews(spark, path, buckets).revenue.read()
    return rows.select("supplier", "first.brand", "revenue", "lines_sold").orderBy(F.col("revenue").desc(), "supplier")


def usage_report(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """As ``reports.category_usage`` of the lines and the catalogue after all changes."""
    views = ReportViews(spark, path, buckets)
    nameless = views.written.read(views.written.touched(spark.sql("SELECT CAST(NULL AS STRING) AS name")))
    no_name = not nameless.filter("name IS NULL AND n > 0").isEmpty()
    unused = F.lit(None).cast("bigint") if no_name else F.nullif(F.col("total") - F.col("used"), F.lit(0))
    return views.usage.read().select("category", F.nullif("used", F.lit(0)).alias("used"),
                                     unused.alias("unused"), "total").orderBy("category")
