"""Streaming forms of the operators that react to row events.

Each ``stream_*`` function returns a streaming DataFrame or a started query. Events carry ``seq``, a number that
orders them, because effects on one part or order depend on the sequence.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from wrenchline.operators.gates import MODEL, catalog_models
from wrenchline.operators.maintenance import latest_per_key, purge
from wrenchline.operators.orders import approvals_of, cost_value, line_amount
from wrenchline.operators.skew import sized
from wrenchline.operators.stock import (
    hot_parts, pending_stock, receipt_decisions, starting_state, state_after,
)
from wrenchline.schemas import PART_UNSUITABLE, REFUSED, VEHICLE_UNKNOWN
from wrenchline.session import pinned
from wrenchline.sources.versions import claim, is_written, read_version, start_versions, write_version


def event_source(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                 glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Event files as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet files, exactly once, until all available input is read."""
    return (stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.foreachBatch(action).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def evaluate(batch: DataFrame) -> None:
    """Run a repeated micro-batch whose output is stored already: the engine asks that its state be committed again."""
    batch.write.format("noop").mode("overwrite").save()


# --- stateless --------------------------------------------------------------------------------

def stream_gate(stream: DataFrame, catalog: DataFrame, model: Sequence[str] = MODEL) -> DataFrame:
    """Arriving vehicles, or arriving lines that carry ``part_code`` and their vehicle's model.

    ``reason`` is NULL for accepted rows. One stream with a mark, so that one pass feeds both outputs. What the
    catalogue supports is worked out once, when the stream is defined, and broadcast while it is small.
    """
    by_part = "part_code" in stream.columns
    keys = ["part_code", *model] if by_part else list(model)
    known = (catalog.select(*keys).dropna().distinct() if by_part else catalog_models(catalog, model))
    marked = stream.join(sized(pinned(known.withColumn("_known", F.lit(True)))), keys, "left")
    message = PART_UNSUITABLE if by_part else VEHICLE_UNKNOWN
    return marked.withColumn("reason", F.when(F.col("_known").isNull(), F.lit(message))).drop("_known")


def stream_final_cost(stream: DataFrame, quotes: DataFrame,
                      today: datetime.date | None = None) -> DataFrame:
    """Labor events (order_id, seq, labor) to closed orders: cost from the quote (order_id, quote) and end date.

    The quotes are worked out once, when the stream is defined.
    """
    quotes = sized(pinned(quotes.select("order_id", "quote")))
    day = F.lit(today) if today else F.current_date()
    closed = stream.filter(F.col("labor") != 0).join(quotes, "order_id")
    return closed.select("order_id", "seq", "labor", cost_value().alias("final_cost"), day.alias("end_date"))


# --- keyed state held by the engine ------------------------------------------------------------

def stream_default_decision(stream: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """A refusal, once, for every order id seen that has no stored decision (``decisions``, as of the start).

    The ids seen are state that grows with the orders; orders with a stored decision do not enter it.
    """
    opened = stream.select("order_id")
    if decisions is not None:
        opened = opened.join(sized(pinned(decisions.select("order_id").distinct())), "order_id", "left_anti")
    return opened.dropDuplicates(["order_id"]).withColumn("outcome", F.lit(REFUSED))


def running_quotes(lines_stream: DataFrame) -> DataFrame:
    """Quote per order over all lines so far (update mode)."""
    return lines_stream.groupBy("order_id").agg(F.sum(line_amount()).alias("quote"))


def stream_quote(lines_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log each micro-batch's changed quotes under ``path/batch=<n>``; only changed orders are written.

    A path belongs to one checkpoint.
    """
    def log(changed: DataFrame, batch_id: int) -> None:
        claim(changed.sparkSession, path, checkpoint)
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(running_quotes(lines_stream), log, checkpoint, "update")


def current_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Latest logged quote per order."""
    return latest_per_key(spark.read.parquet(path), ["order_id"], "batch")


# --- tables kept as versions -------------------------------------------------------------------

def stream_decisions(stream: DataFrame, lines: DataFrame, catalog: DataFrame, pending: DataFrame,
                     path: str, checkpoint: str) -> StreamingQuery:
    """Approval events (order_id, outcome, seq) to pending stock, version n+1 after micro-batch n.

    A repeated micro-batch finds its version complete and does nothing. A path belongs to one checkpoint.
    """
    start_versions(pending.select("part_code", "quantity", "supplier"), path)

    def reorder(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        claim(spark, path, checkpoint)
        if is_written(spark, path, batch_id + 1):
            return
        stock = read_version(spark, path, batch_id)
        write_version(pending_stock(stock, lines, approvals_of(events), catalog), path, batch_id + 1)

    return each_batch(stream, reorder, checkpoint)


def stream_purge(stream: DataFrame, pending: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving vehicles clear pending rows with nothing left on order.

    A micro-batch without vehicles writes nothing; the current version then stays the newest below its number.
    """
    start_versions(pending, path)

    def clear(vehicles: DataFrame, batch_id: int) -> None:
        spark = vehicles.sparkSession
        claim(spark, path, checkpoint)
        if is_written(spark, path, batch_id + 1) or vehicles.isEmpty():
            return
        stock = read_version(spark, path, batch_id)
        write_version(purge(stock, F.col("quantity") == 0), path, batch_id + 1)

    return each_batch(stream, clear, checkpoint)


def stream_receipts(stream: DataFrame, lines: DataFrame, pending: DataFrame, path: str,
                    checkpoint: str) -> StreamingQuery:
    """Arrival events (part_code, seq, arrived) to oldest-first fulfilment of ``lines``.

    State per part is two numbers, stock on order and position in the part's running total, kept as versions
    under ``path/state``; decisions are logged under ``path/decisions/batch=<n>``. The queue of waiting lines is
    not state: it is read from the lines table, so a part with very many lines costs no more than in batch.
    """
    states = f"{path}/state"
    start_versions(starting_state(pending), states)
    hot = hot_parts(lines)  # once for all micro-batches, as the lines do not change

    def receive(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        claim(spark, states, checkpoint)
        if is_written(spark, states, batch_id + 1):
            return
        state = read_version(spark, states, batch_id)
        log = f"{path}/decisions/batch={batch_id}"
        receipt_decisions(lines, state, events, hot=hot).write.mode("overwrite").parquet(log)
        write_version(state_after(state, spark.read.parquet(log)), states, batch_id + 1)

    return each_batch(stream, receive, checkpoint)
