"""Streams into tables that are changed where the events touch them.

The tables are hash-bucketed with a manifest (``sources.buckets``) or a levelled log (``sources.runs``): what a micro-batch reads
and writes follows the keys of its events, not the size of the tables. Micro-batch n makes version n + 1; a repeated
one finds its version and does nothing, a half-written version is written again, and a path belongs to one checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wrenchline.operators.maintenance import purge
from wrenchline.operators.orders import approvals_of
from wrenchline.operators.stock import pending_stock, supplier_of_part
from wrenchline.schemas import REFUSED
from wrenchline.session import pinned
from wrenchline.sources.buckets import Buckets
from wrenchline.sources.manifests import is_committed
from wrenchline.sources.runs import append_run, read_runs
from wrenchline.sources.versions import claim
from wrenchline.streaming.streams import each_batch, evaluate, running_quotes

BUCKETS = 64


def stock_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Buckets:
    """Stock on order by part; each bucket knows the range of its quantities."""
    return Buckets(spark, path, ("part_code",), buckets, "quantity")


def decisions_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Buckets:
    return Buckets(spark, path, ("order_id",), buckets)


def stream_decisions_bucketed(stream: DataFrame, lines: DataFrame, catalog: DataFrame, pending: DataFrame, path: str,
                              checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Approval events (order_id, outcome, seq) to stock on order, see ``stock_table`` at ``path/stock``.

    Lines by order and suppliers by part are bucketed once, under ``path/lines`` and ``path/suppliers``; a micro-batch
    opens the buckets of its orders and of the parts these need, and writes the latter.
    """
    spark = stream.sparkSession
    order_lines = Buckets(spark, f"{path}/lines", ("order_id",), buckets)
    suppliers = Buckets(spark, f"{path}/suppliers", ("part_code",), buckets)
    stock = stock_table(spark, f"{path}/stock", buckets)
    order_lines.create(lines.select("order_id", "part_code", "needed"))
    suppliers.create(supplier_of_part(catalog).withColumn("version", F.lit(1)))
    stock.create(pending.select("part_code", "quantity", "supplier"))

    def reorder(events: DataFrame, batch_id: int) -> None:
        claim(spark, path, checkpoint)
        if stock.is_written(batch_id + 1):
            return
        approvals = pinned(approvals_of(events).select("order_id"))
        wanted = pinned(order_lines.read(order_lines.touched(approvals)).join(
            approvals.groupBy("order_id").agg(F.count("*").alias("times")), "order_id")
            .select("order_id", "part_code", (F.col("needed") * F.col("times")).alias("needed")))
        touched = stock.touched(wanted)
        once = wanted.select("order_id").distinct()
        stock.update(batch_id + 1, touched, lambda rows: pending_stock(rows, wanted, once, suppliers.read(touched)))

    return each_batch(stream, reorder, checkpoint)


def stream_purge_bucketed(stream: DataFrame, pending: DataFrame, path: str, checkpoint: str,
                          buckets: int = BUCKETS) -> StreamingQuery:
    """Arriving vehicles clear stock rows with nothing left on order, see ``stock_table`` at ``path``.

    Only buckets whose range of quantities holds 0 are opened, and only those with such a row are written.
    """
    spark = stream.sparkSession
    stock = stock_table(spark, path, buckets)
    stock.create(pending)

    def clear(vehicles: DataFrame, batch_id: int) -> None:
        claim(spark, path, checkpoint)
        if stock.is_written(batch_id + 1) or vehicles.isEmpty():
            return
        finished = stock.read(stock.within_zone(0)).filter(F.col("quantity") == 0)
        stock.update(batch_id + 1, stock.touched(finished), lambda rows: purge(rows, F.col("quantity") == 0))

    return each_batch(stream, clear, checkpoint)


def stream_default_decision_bounded(stream: DataFrame, decisions: DataFrame, path: str, checkpoint: str,
                                    event_time: str, delay: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A refusal for every opened order (order_id and its event time) that has no decision when it is seen, in the
    ``decisions_table`` at ``path``.

    Repeats within ``delay`` are dropped by state that the watermark clears, so the state is as large as the orders of that
    time. A later repeat meets the table, as do decisions that others have written since the start: no order gets
    a second row.
    """
    spark = stream.sparkSession
    table = decisions_table(spark, path, buckets)
    table.create(decisions.select("order_id", "outcome"))
    opened = stream.select("order_id", event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["order_id"])

    def refuse(orders: DataFrame, batch_id: int) -> None:
        claim(spark, path, checkpoint)
        if table.is_written(batch_id + 1):
            return evaluate(orders)
        seen = pinned(orders.select("order_id").filter(F.col("order_id").isNotNull()).distinct())
        known = table.read(table.touched(seen)).select("order_id")
        missing = pinned(seen.join(known, "order_id", "left_anti").withColumn("outcome", F.lit(REFUSED)))
        table.update(batch_id + 1, table.touched(missing), lambda rows: rows.unionByName(missing))

    return each_batch(opened, refuse, checkpoint)


def stream_quote_compacted(lines_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Quotes per order as a levelled log, read by ``compacted_quotes``: only changed quotes are written."""
    return each_batch(running_quotes(lines_stream), quote_log(path, checkpoint), checkpoint, "update")


def quote_log(path: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def log(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        claim(spark, path, checkpoint)
        if is_committed(spark, path, batch_id + 1):
            return evaluate(changed)
        append_run(changed, path, batch_id, ["order_id"])

    return log


def compacted_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Latest quote per order; the runs to open grow with the logarithm of the micro-batches."""
    return read_runs(spark, path, ["order_id"])
