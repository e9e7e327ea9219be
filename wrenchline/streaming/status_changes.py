"""Status of orders as a stream: what was opened, ordered, decided and worked comes in, changes of status come out.

The four inputs are brought to one form and grouped by order, so the engine keeps one small row of sums per order and
no buffer of rows that wait for a partner. A line comes with weight 1, goes with weight -1, and changes as both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wrenchline.operators.orders import cost_value, line_amount, status_of
from wrenchline.session import pinned
from wrenchline.sources.buckets import Buckets
from wrenchline.sources.versions import claim
from wrenchline.streaming.streams import each_batch, evaluate

BUCKETS = 64


def status_events(opened: DataFrame, lines: DataFrame, decisions: DataFrame, labor: DataFrame) -> DataFrame:
    """One form for opened orders (order_id), lines (order_id, price, needed, available, weight), decisions (order_id,
    outcome, seq) and hours (order_id, labor, seq)."""
    parts = [
        opened.select("order_id", F.lit(True).alias("opened")),
        lines.select("order_id", line_amount().alias("amount"), *[
            F.col(c).cast("bigint") for c in ("needed", "available", "weight")]),
        decisions.select("order_id", "outcome", F.col("seq").cast("bigint").alias("decided")),
        labor.select("order_id", F.col("labor").cast("bigint"), F.col("seq").cast("bigint").alias("worked"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _weighted(value: str) -> Column:
    """Sum over the lines that are there; NULL when none of them has a value, as a plain sum would be."""
    known = F.sum(F.when(F.col(value).isNotNull(), F.col("weight")))
    return F.when(known != 0, F.sum(F.col(value) * F.col("weight")))


def running_status(events: DataFrame) -> DataFrame:
    """(order_id, status) of every opened order from the ``status_events`` so far (update mode).

    The decision and the hours with the largest ``seq`` count, also those that came before the order. What names no
    opened order has no status until the order is opened.
    """
    sums = events.groupBy("order_id").agg(
        F.max("opened").alias("_opened"), F.sum("weight").alias("_lines"),
        _weighted("needed").alias("_needed"), _weighted("available").alias("_available"),
        _weighted("amount").alias("_quote"), F.max_by("outcome", "decided").alias("outcome"),
        F.max_by("labor", "worked").alias("labor"))
    quote = F.coalesce("_quote", F.lit(0)).cast("decimal(28,2)")
    cost = F.when(F.col("labor") != 0, cost_value(quote="_quote")).otherwise(F.lit(0))
    return (sums.filter("_opened").withColumn("_quote", quote)
            .select("order_id", status_of(cost).alias("status")))


def status_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Buckets:
    """The current (order_id, status) of the orders at ``path``."""
    return Buckets(spark, f"{path}/current", ("order_id",), buckets)


def stream_order_status(opened: DataFrame, lines: DataFrame, decisions: DataFrame, labor: DataFrame, path: str,
                        checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Log (order_id, previous, status) of each order whose status a micro-batch changes, see ``status_log``, and keep
    ``status_table`` at it.

    What is logged is compared with the table, so that an order which is only touched is not logged. The log of a
    micro-batch is written before its version of the table: a repeated one writes the same log, or nothing.
    """
    spark = opened.sparkSession
    table = status_table(spark, path, buckets)
    running = running_status(status_events(opened, lines, decisions, labor))
    table.create(spark.createDataFrame([], running.schema))

    def log(touched: DataFrame, batch_id: int) -> None:
        claim(spark, path, checkpoint)
        if table.is_written(batch_id + 1):
            return evaluate(touched)
        now = pinned(touched)
        known = table.read(table.touched(now)).withColumnRenamed("status", "previous")
        moved = now.join(known, "order_id", "left").filter(~F.col("status").eqNullSafe(F.col("previous")))
        folder = f"{path}/changes/batch={batch_id}"
        moved.select("order_id", "previous", "status").write.mode("overwrite").parquet(folder)
        changed = spark.read.parquet(folder).select("order_id", "status")
        table.update(batch_id + 1, table.touched(changed), lambda rows: rows.join(
            changed.select("order_id"), "order_id", "left_anti").unionByName(changed))

    return each_batch(running, log, checkpoint, "update")


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """(order_id, previous, status, batch): every change of status, ``previous`` NULL for a new order."""
    return spark.read.parquet(f"{path}/changes")
