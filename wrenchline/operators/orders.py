"""State derived for work orders: quote, cost, decision, status, balance and numbering."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.maintenance import increment_by_key, update_by_key
from wrenchline.operators.skew import lookup_join, sliced_totals
from wrenchline.schemas import (
    ACCEPTED, HOURLY_RATE, PARTS_MARKUP, PARTS_SHARE_PERCENT, REFUSED, STATUS_DONE, STATUS_INTAKE,
    STATUS_REFUSED, STATUS_WAITING, STATUS_WORKING,
)

# Hold every price and quantity of the declared types (int, smallint), and their product still has 18 digits, which
# Spark computes with as a long.
PRICE = "decimal(12,2)"
QUANTITY = "decimal(5,0)"


def line_amount(price: str = "price", quantity: str = "needed") -> Column:
    """Price of the line (not of the catalogue) times quantity, exact."""
    return F.col(price).cast(PRICE) * F.col(quantity).cast(QUANTITY)


def line_totals(lines: DataFrame, strict_null: bool = False) -> DataFrame:
    """Quote per order. With ``strict_null`` one unknown amount makes the whole quote unknown."""
    amount = line_amount()
    total = F.sum(amount)
    if strict_null:
        total = F.when(F.count_if(amount.isNull()) == 0, total)
    return lines.groupBy("order_id").agg(total.alias("quote"), F.count("*").alias("_lines"))


def order_quote(orders: DataFrame, lines: DataFrame, strict_null: bool = False) -> DataFrame:
    """Orders with ``quote`` = sum of price × needed over their lines, 0 without lines."""
    totals = line_totals(lines, strict_null)
    joined = orders.drop("quote").join(totals, "order_id", "left")
    quote = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.col("quote"))
    if not strict_null:
        quote = F.coalesce(quote, F.lit(0))
    return joined.withColumn("quote", quote.cast("decimal(28,2)")).drop("_lines")


def quote_delta(orders: DataFrame, new_lines: DataFrame) -> DataFrame:
    """Add new lines to quotes already there; only the new lines are read."""
    deltas = line_totals(new_lines).select("order_id", "quote")
    return increment_by_key(orders, deltas, ["order_id"], "quote")


def cost_value(labor: str = "labor", quote: str = "quote", rate: int = HOURLY_RATE,
               markup: str = PARTS_MARKUP) -> Column:
    """labor × rate + quote × markup, rounded half away from zero."""
    work = F.col(labor).cast("decimal(10,0)") * F.lit(rate)
    parts = F.col(quote).cast("decimal(20,2)") * F.lit(markup).cast("decimal(5,3)")
    return F.round(work + parts, 0).cast("bigint")


def final_cost(orders: DataFrame, rate: int = HOURLY_RATE, markup: str = PARTS_MARKUP,
               today: datetime.date | None = None, changed: Column | None = None) -> DataFrame:
    """Cost and end date of orders with labor; others keep theirs. ``today`` defaults to the current date.

    ``changed`` limits the work to orders that were updated; without it every order counts as updated.
    """
    closed = F.col("labor") != 0 if changed is None else (F.col("labor") != 0) & changed
    day = F.lit(today) if today else F.current_date()
    return orders.withColumns({
        "final_cost": F.when(closed, cost_value(rate=rate, markup=markup))
                       .otherwise(F.col("final_cost").cast("bigint")),
        "end_date": F.when(closed, day).otherwise(F.col("end_date")),
    })


def default_decision(orders: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions plus a refusal for each order that has none."""
    missing = orders.select("order_id").join(decisions.select("order_id"), "order_id", "left_anti")
    return decisions.unionByName(missing.withColumn("outcome", F.lit(REFUSED)))


def decide(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply decision updates (order_id, outcome, seq): the last per order wins, unknown orders are ignored."""
    return update_by_key(decisions, updates, ["order_id"], "seq")


def approvals_of(updates: DataFrame) -> DataFrame:
    return updates.filter(F.col("outcome") == ACCEPTED)


def order_status(orders: DataFrame, lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """(order_id, status): first match of intake, refused, waiting for parts, in progress, done.

    Sums are compared per order. An unknown comparison counts as not met, as in the ``when`` chain.
    """
    sums = lines.groupBy("order_id").agg(*_line_counts())
    return (orders.select("order_id", "final_cost")
            .join(sums, "order_id", "left")
            .join(decisions.select("order_id", "outcome"), "order_id", "left")
            .select("order_id", status_of(F.col("final_cost")).alias("status")))


def _line_counts() -> list[Column]:
    return [F.count("*").alias("_lines"), F.sum("needed").alias("_needed"), F.sum("available").alias("_available")]


def status_of(final_cost: Column) -> Column:
    """Status from the sums of ``_line_counts``, ``outcome`` and a cost."""
    return (
        F.when(F.coalesce(F.col("_lines"), F.lit(0)) == 0, STATUS_INTAKE)
        .when(F.col("outcome") == REFUSED, STATUS_REFUSED)
        .when(F.col("_needed") != F.col("_available"), STATUS_WAITING)
        .when(final_cost == 0, STATUS_WORKING)
        .otherwise(STATUS_DONE))


def priced_order_status(orders: DataFrame, lines: DataFrame, decisions: DataFrame, rate: int = HOURLY_RATE,
                        markup: str = PARTS_MARKUP) -> DataFrame:
    """``order_status`` of orders that are priced on the way (order_id, labor): quote, cost and the sums that the
    status compares come from one grouping of the lines."""
    sums = lines.groupBy("order_id").agg(F.sum(line_amount()).alias("_quote"), *_line_counts())
    quote = F.coalesce("_quote", F.lit(0)).cast("decimal(28,2)")
    cost = F.when(F.col("labor") != 0, cost_value(quote="_quote", rate=rate, markup=markup)).otherwise(F.lit(0))
    return (orders.select("order_id", "labor")
            .join(sums, "order_id", "left").withColumn("_quote", quote)
            .join(decisions.select("order_id", "outcome"), "order_id", "left")
            .select("order_id", status_of(cost).alias("status")))


def balance(orders: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    """One row: a share of the quotes of closed orders, rounded, plus all labor at the hourly rate."""
    sums = orders.agg(
        F.sum(F.when(F.col("labor") != 0, F.col("quote").cast("decimal(28,2)"))).alias("_quotes"),
        F.sum("labor").alias("_labor"))
    share = F.round(F.col("_quotes") * F.lit(PARTS_SHARE_PERCENT) / F.lit(100), 0).cast("bigint")
    return sums.select((share + F.col("_labor") * F.lit(rate)).alias("balance"))


def rest_after(quantity: Column, arrived: Column) -> Column:
    """What stays on order: unchanged on over-delivery, otherwise the difference; 0 when unknown."""
    rest = quantity - arrived
    return F.when(rest < 0, quantity).when(rest > 0, rest).otherwise(F.lit(0))


def receipt_remaining(pending: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts (part_code, arrived) with ``remaining`` for the part's stock on order."""
    joined = lookup_join(receipts, pending.select("part_code", "quantity"), ["part_code"], "left")
    return joined.withColumn("remaining", rest_after(F.col("quantity"), F.col("arrived"))).drop("quantity")


def next_ids(new_rows: DataFrame, existing: DataFrame, id_col: str, order_by: list[str]) -> DataFrame:
    """Contiguous new ids after the largest existing one, in the order of ``order_by`` (unique).

    The rank comes from range slices and their offsets; no task sees all rows.
    """
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("top")).first()["top"]
    ranked = sliced_totals(new_rows, [], [F.col(c) for c in order_by], {"_rank": F.lit(1)})
    return ranked.withColumn(id_col, F.col("_rank") + F.lit(top)).drop("_rank")
