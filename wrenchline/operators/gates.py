"""Compatibility gates: which arriving vehicles and order lines the catalogue supports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.skew import lookup_join
from wrenchline.schemas import PART_UNSUITABLE, VEHICLE_UNKNOWN

MODEL = ("brand", "model", "trim")


def catalog_models(catalog: DataFrame, model: Sequence[str] = MODEL) -> DataFrame:
    """The vehicle models some part exists for."""
    return catalog.select(*model).dropna().distinct()


def vehicle_gate(vehicles: DataFrame, catalog: DataFrame,
                 model: Sequence[str] = MODEL) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a vehicle needs a catalogue row of its model. To write both, split ``marked_vehicles``."""
    marked = marked_vehicles(vehicles, catalog, model)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def marked_vehicles(vehicles: DataFrame, catalog: DataFrame, model: Sequence[str] = MODEL) -> DataFrame:
    """Both outputs of the gate in one pass: rows with ``reason``, NULL for accepted ones."""
    known = catalog_models(catalog, model).withColumn("_known", F.lit(True))
    marked = lookup_join(vehicles, known, model, "left")
    return marked.withColumn("reason", F.when(F.col("_known").isNull(), F.lit(VEHICLE_UNKNOWN))).drop("_known")


def marked_lines(lines: DataFrame, orders: DataFrame, vehicles: DataFrame, catalog: DataFrame,
                 model: Sequence[str] = MODEL) -> DataFrame:
    """Order lines with ``reason``: NULL when the part fits the vehicle of the order.

    Lines whose order or vehicle is missing do not fit. Orders meet vehicles first: both sides are far
    smaller than the lines, which are then joined once by order and once by (part, model).
    """
    fitted = vehicles.select("plate", *[F.col(c).alias(f"_{c}") for c in model])
    models = lookup_join(orders.select("order_id", "plate"), fitted, ["plate"]).drop("plate")
    with_model = lookup_join(lines, models, ["order_id"], "left")
    parts = catalog.select("part_code", *[F.col(c).alias(f"_{c}") for c in model]).dropna().distinct()
    on = ["part_code", *[f"_{c}" for c in model]]
    # Looking for hot keys here would run the joins above twice. Nothing above this join needs its partitioning,
    # so AQE may split a skewed partition of the lines.
    marked = with_model.join(parts.withColumn("_fits", F.lit(True)), on, "left")
    reason = F.when(F.col("_fits").isNull(), F.lit(PART_UNSUITABLE))
    return marked.withColumn("reason", reason).select(*lines.columns, "reason")


def part_gate(lines: DataFrame, orders: DataFrame, vehicles: DataFrame, catalog: DataFrame,
              model: Sequence[str] = MODEL) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) order lines."""
    marked = marked_lines(lines, orders, vehicles, catalog, model)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
