"""Reports on workload, revenue and use of parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.skew import not_in
from wrenchline.operators.stock import by_number
from wrenchline.schemas import MECHANIC


def mechanic_hours(staff: DataFrame, people: DataFrame, orders: DataFrame, role: str = MECHANIC) -> DataFrame:
    """(staff_id, first_name, hours, orders) per mechanic. Orders are added up per mechanic before any join."""
    work = orders.groupBy(F.col("mechanic").alias("staff_id")).agg(
        F.sum("labor").alias("hours"), F.count("order_id").alias("orders"))
    named = staff.filter(F.col("role") == role).select("staff_id", "person_id").join(
        people.select("person_id", "first_name"), "person_id")
    return named.join(work, "staff_id").select("staff_id", "first_name", "hours", "orders")


def min_mechanic_hours(staff: DataFrame, people: DataFrame, orders: DataFrame) -> DataFrame:
    return mechanic_hours(staff, people, orders).agg(F.min("hours").alias("min_hours"))


def one_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; reduced on the map side."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])


def first_version() -> list[Column]:
    """Order of catalogue rows when one must be picked: smallest code as a number, then version."""
    return [by_number("part_code"), F.col("version")]


def supplier_revenue(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """(supplier, brand, revenue, lines_sold), best first: catalogue price per line, quantity not counted.

    The brand is that of the supplier's smallest part code sold.
    """
    sold = lines.groupBy("part_code").agg(F.count("*").alias("_n"))
    priced = catalog.groupBy("part_code").agg(
        F.min_by(F.struct("supplier", "brand", "price"), "version").alias("_row")).select("part_code", "_row.*")
    return (sold.join(priced, "part_code").groupBy("supplier")
            .agg(F.min_by("brand", by_number("part_code")).alias("brand"),
                 F.sum(F.col("price").cast("decimal(18,2)") * F.col("_n")).alias("revenue"),
                 F.sum("_n").alias("lines_sold"))
            .orderBy(F.col("revenue").desc(), "supplier"))


def _collated(df: DataFrame, columns: Sequence[str], collation: str | None) -> DataFrame:
    if collation is None:
        return df
    return df.withColumns({c: F.collate(F.col(c), collation) for c in columns if c in df.columns})


def _names(catalog: DataFrame, collation: str | None) -> DataFrame:
    """(name, category) of one catalogue row per part name."""
    needed = _collated(catalog.select("part_code", "version", "name", "category"), ["name", "category"], collation)
    return one_per_key(needed, "name", first_version()).select("name", "category")


def _used(lines: DataFrame, collation: str | None) -> DataFrame:
    return _collated(lines.select("name"), ["name"], collation).distinct()


def _categories(catalog: DataFrame, collation: str | None) -> DataFrame:
    return _collated(catalog.select("category"), ["category"], collation).distinct()


def parts_one_per_name(catalog: DataFrame) -> DataFrame:
    return one_per_key(catalog, "name", first_version())


def unused_parts(catalog: DataFrame, lines: DataFrame, collation: str | None = None) -> DataFrame:
    """(category, parts): names on no order line, per category, fewest first."""
    unused = not_in(_names(catalog, collation), "name", _used(lines, collation), "name")
    return unused.groupBy("category").agg(F.count("*").alias("parts")).orderBy("parts", "category")


def unused_all_categories(catalog: DataFrame, lines: DataFrame, collation: str | None = None) -> DataFrame:
    """``unused_parts`` for every category, NULL where there is none."""
    counts = unused_parts(catalog, lines, collation)
    return _categories(catalog, collation).join(counts, "category", "left").orderBy("category")


def used_all_categories(catalog: DataFrame, lines: DataFrame, collation: str | None = None) -> DataFrame:
    """Names on some order line per category, for every category, NULL where there is none."""
    counts = _names(catalog, collation).join(_used(lines, collation), "name") \
        .groupBy("category").agg(F.count("*").alias("parts"))
    return _categories(catalog, collation).join(counts, "category", "left").orderBy("category")


def names_by_category(catalog: DataFrame, collation: str | None = None) -> DataFrame:
    return _names(catalog, collation).groupBy("category").agg(F.count("*").alias("parts")).orderBy("category")


def category_usage(catalog: DataFrame, lines: DataFrame, collation: str | None = None) -> DataFrame:
    """(category, used, unused, total) in one pass over names; 0 is shown as NULL.

    Categories that win no name are left out. An order line without name makes every unused count NULL, because
    a name is then never known to be unused.
    """
    used = _used(lines, collation)
    no_name = used.filter(F.col("name").isNull()).exists()
    marked = _names(catalog, collation).join(used.withColumn("_used", F.lit(True)), "name", "left")
    counts = marked.groupBy("category").agg(
        F.count_if(F.col("_used")).alias("used"), F.count_if(F.col("_used").isNull()).alias("unused"),
        F.count("*").alias("total"))
    unused = F.when(~no_name, F.col("unused"))
    return counts.select("category", F.nullif("used", F.lit(0)).alias("used"),
                         F.nullif(unused, F.lit(0)).alias("unused"), "total").orderBy("category")
