"""A whole batch of shop events as one job per step, in the order the events depend on each other.

Each step writes the rows it changed to the reliable checkpoint folder, so that the next step starts from
stored rows instead of repeating all steps before it.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.gates import MODEL, marked_lines, marked_vehicles
from wrenchline.operators.maintenance import purge, update_by_key
from wrenchline.operators.orders import (
    approvals_of, decide, default_decision, final_cost, next_ids, order_status, quote_delta,
)
from wrenchline.operators.staff import assign_mechanics
from wrenchline.operators.stock import pending_stock, receipt_decisions, stock_after, supplied_lines
from wrenchline.session import pinned
from wrenchline.sources.tables import apply_defaults

Tables = Mapping[str, DataFrame]


def take_vehicles(tables: Tables, vehicles: DataFrame, model=MODEL) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, rejected): known models are added; an arrival also clears finished pending rows."""
    accepted, rejected = _split(pinned(marked_vehicles(vehicles, tables["catalog"], model)))
    pending = tables["pending"]
    if not accepted.isEmpty():
        pending = purge(pending, F.col("quantity") == 0)
    return {**tables, "vehicles": tables["vehicles"].unionByName(accepted), "pending": pending}, rejected


def _split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def open_orders(tables: Tables, requests: DataFrame, order_by: list[str]) -> dict[str, DataFrame]:
    """New orders (plate, start_date and the columns of ``order_by``): number, mechanic, defaults and refusal."""
    numbered = next_ids(requests, tables["orders"], "order_id", order_by)
    defaulted = apply_defaults(numbered, {"labor": 0, "quote": 0, "final_cost": 0})
    placed = assign_mechanics(defaulted, tables["staff"], tables["orders"])
    schema = tables["orders"].schema
    new = placed.withColumn("end_date", F.lit(None)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    orders = tables["orders"].unionByName(pinned(new))
    return {**tables, "orders": orders, "decisions": default_decision(orders, tables["decisions"])}


def add_lines(tables: Tables, lines: DataFrame, today: datetime.date | None = None,
              model=MODEL) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, rejected): fitting lines are added and quotes and costs follow."""
    accepted, rejected = _split(pinned(
        marked_lines(lines, tables["orders"], tables["vehicles"], tables["catalog"], model)))
    orders = _repriced(quote_delta(tables["orders"], accepted), accepted, today)
    return {**tables, "lines": tables["lines"].unionByName(accepted), "orders": orders}, rejected


def _repriced(orders: DataFrame, events: DataFrame, today: datetime.date | None) -> DataFrame:
    """Recompute cost and end date of the orders some event names."""
    touched = events.select("order_id").distinct().withColumn("_touched", F.lit(True))
    marked = orders.join(touched, "order_id", "left")
    priced = final_cost(marked, today=today, changed=F.col("_touched").isNotNull())
    return pinned(priced.select(*orders.columns))


def apply_decisions(tables: Tables, updates: DataFrame) -> dict[str, DataFrame]:
    """Customer decisions (order_id, outcome, seq); approvals order the parts needed."""
    known = updates.join(tables["decisions"].select("order_id"), "order_id", "left_semi")
    stock = pending_stock(tables["pending"], tables["lines"], approvals_of(known), tables["catalog"])
    return {**tables, "decisions": pinned(decide(tables["decisions"], updates)), "pending": pinned(stock)}


def record_labor(tables: Tables, labor: DataFrame, today: datetime.date | None = None) -> dict[str, DataFrame]:
    """Labor (order_id, labor, seq) closes orders with cost and date."""
    orders = update_by_key(tables["orders"], labor, ["order_id"], "seq")
    return {**tables, "orders": _repriced(orders, labor, today)}


def receive_goods(tables: Tables, receipts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, decisions) after arrivals (part_code, seq, arrived)."""
    decisions = pinned(receipt_decisions(tables["lines"], tables["pending"], receipts))
    return {**tables, "lines": pinned(supplied_lines(tables["lines"], decisions)),
            "pending": pinned(stock_after(tables["pending"], decisions))}, decisions


def statuses(tables: Tables) -> DataFrame:
    return order_status(tables["orders"], tables["lines"], tables["decisions"])
