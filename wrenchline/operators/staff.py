"""Choosing mechanics for new orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.skew import Ordinary, by_route
from wrenchline.schemas import MECHANIC


def free_mechanics(staff: DataFrame, orders: DataFrame, null_safe: bool = False,
                   role: str = MECHANIC) -> DataFrame:
    """Mechanics without an open order. An open order without mechanic empties the list (as NOT IN does),
    unless ``null_safe``. Orders are read twice: for two counts, and for the open orders' mechanics."""
    mechanics = staff.filter(F.col("role") == role)
    opened = orders.filter(F.col("labor") == 0).select("mechanic")
    busy = opened.dropna().distinct()
    if null_safe:
        unnamed, named = F.lit(0), busy.agg(F.count("*").alias("n"))
    else:
        counts = opened.agg(F.count_if(F.col("mechanic").isNull()).alias("unnamed"), F.count("*").alias("n"))
        unnamed, named = counts.select("unnamed").scalar(), counts.select("n")
    # NULL NOT IN (...) is true of an empty list only.
    kept = mechanics.filter(unnamed == 0).filter(F.col("staff_id").isNotNull() | (named.scalar() == 0))
    return kept.join(busy.withColumnRenamed("mechanic", "staff_id"), "staff_id", "left_anti")


def hours_by_mechanic(orders: DataFrame) -> DataFrame:
    return orders.groupBy("mechanic").agg(F.sum("labor").alias("hours"))


def least_loaded(orders: DataFrame) -> DataFrame:
    """(mechanic, hours) of those whose total equals the least total; only mechanics seen in orders."""
    hours = hours_by_mechanic(orders)
    least = hours.agg(F.min("hours").alias("least"))
    return hours.filter(F.col("hours") == least.scalar())


def crews(staff: DataFrame, orders: DataFrame, branch: str) -> DataFrame:
    """One row per branch: ``_free``, the ids of its free mechanics in order, and ``_fallback``, who takes further orders.

    One aggregate of the orders by branch and mechanic tells who is busy, who has worked how long, and whether an open
    order has no mechanic, which leaves nobody free. The fallback is only asked for once every free mechanic has got an
    order, so these count with at least zero hours. A branch has far fewer mechanics than orders.
    """
    loads = orders.groupBy(branch, F.col("mechanic").alias("_id")).agg(
        F.max(F.coalesce(F.col("labor") == 0, F.lit(False))).alias("_open"), F.sum(F.col("labor").cast("bigint")).alias("_hours"))
    mechanics = staff.filter((F.col("role") == MECHANIC) & F.col("staff_id").isNotNull() & F.col(branch).isNotNull()) \
        .select(branch, F.col("staff_id").alias("_id"), F.lit(True).alias("_member"))
    everyone = loads.join(mechanics, [branch, "_id"], "full")
    idle = F.col("_member") & ~F.coalesce("_open", F.lit(False))
    crew = everyone.groupBy(branch).agg(
        F.max(F.col("_open") & F.col("_id").isNull()).alias("_blocked"),
        F.sort_array(F.collect_set(F.when(idle, F.col("_id")))).alias("_idle"),
        F.min(F.when(F.col("_hours").isNotNull(), _load("_hours"))).alias("_worked"),
        F.min(F.when(idle, _load(F.coalesce("_hours", F.lit(0).cast("bigint"))))).alias("_rested"))
    blocked = F.coalesce("_blocked", F.lit(False))
    best = F.when(blocked, F.col("_worked")).otherwise(F.least("_worked", "_rested"))
    return crew.select(branch, F.when(~blocked, F.col("_idle")).alias("_free"), best["_id"].alias("_fallback"))


def _load(hours):
    """Fewest hours first, then a known before an unknown mechanic, then the smallest id."""
    hours = F.col(hours) if isinstance(hours, str) else hours
    return F.struct(hours.alias("_hours"), F.col("_id").isNull().alias("_unknown"), F.col("_id").alias("_id"))


def pick_mechanic(staff: DataFrame, orders: DataFrame) -> DataFrame:
    """One row (mechanic): the free mechanic with the smallest id, else the least loaded one."""
    lone = [df.withColumn("_branch", F.lit(0)) for df in (staff, orders)]
    return crews(*lone, "_branch").select(F.coalesce(F.get("_free", F.lit(0)), "_fallback").alias("mechanic"))


def assign_mechanics(new_orders: DataFrame, staff: DataFrame, orders: DataFrame,
                     partition_by: str | None = None) -> DataFrame:
    """New orders with ``mechanic``, as if opened one after the other by order_id.

    The i-th new order takes the i-th free mechanic; when these run out, all further ones go to the least loaded
    mechanic. A mechanic who just got a first order counts with zero hours.
    ``partition_by`` names a branch column that new orders, staff and orders share; without it all
    belong to one branch. Orders of very large branches are numbered in slices, see ``by_route``.
    """
    if partition_by is None:
        lone = [df.withColumn("_branch", F.lit(0)) for df in (new_orders, staff, orders)]
        return assign_mechanics(*lone, partition_by="_branch").drop("_branch")
    branch = partition_by
    per_branch = crews(staff, orders, branch)

    def place(rows: DataFrame, route: Ordinary) -> DataFrame:
        numbered = route.running_totals(rows.drop("mechanic"), [F.col("order_id")], {"_nr": F.lit(1)})
        mechanic = F.coalesce(F.get("_free", F.col("_nr").cast("int") - 1), "_fallback")
        return route.join(numbered, per_branch, "left").withColumn("mechanic", mechanic)

    columns = [*[c for c in new_orders.columns if c != "mechanic"], "mechanic"]
    return by_route(new_orders, [branch], place).select(*columns)
