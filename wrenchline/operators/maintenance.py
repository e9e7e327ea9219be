"""Updates, upserts and deletes as joins over whole batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.skew import lookup_join


def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """Last row per key by ``order_col``; combined on the map side, so repeated keys do not pile up."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def update_by_key(df: DataFrame, patches: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """A batch of ``UPDATE … WHERE key``: the last patch of a key wins, a patch may set NULL."""
    last = latest_per_key(patches, keys, order_col)
    changed = [c for c in last.columns if c not in keys]
    packed = last.select(*keys, F.struct(*changed).alias("_patch"))
    joined = lookup_join(df, packed, keys, "left")
    hit = F.col("_patch").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"_patch.{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in changed else F.col(c) for c in df.columns])


def increment_by_key(df: DataFrame, deltas: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``UPDATE a JOIN b SET a.q = a.q + b.q`` with all deltas of a key added up first; an unknown a.q stays unknown."""
    added = deltas.groupBy(*keys).agg(F.sum(column).alias("_added"))
    joined = lookup_join(df, added, keys, "left")
    return joined.withColumn(column, F.col(column) + F.coalesce(F.col("_added"), F.lit(0))).drop("_added")


def upsert(df: DataFrame, deltas: DataFrame, keys: Sequence[str],
           add_cols: Sequence[str] = ()) -> DataFrame:
    """Change existing keys and insert new ones.

    ``add_cols`` are summed, and an existing unknown value stays unknown as in ``increment_by_key``. Other columns keep the existing row's value (for a new key: the smallest of
    the delta's). Without ``add_cols`` the delta, one row per key, replaces the row.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if add_cols:
        both = df.select(*df.columns, F.lit(0).alias("_src")).unionByName(
            deltas.select(*df.columns, F.lit(1).alias("_src")))
        merged = both.groupBy(*keys).agg(*[
            F.when(F.count_if((F.col("_src") == 0) & F.col(c).isNull()) == 0, F.sum(c)).alias(c) if c in add_cols else F.min(F.struct("_src", c))[c].alias(c) for c in rest])
        return merged.select(*df.columns)
    new = deltas.select(*keys, F.struct(*rest).alias("_new"))
    old = df.select(*keys, F.struct(*rest).alias("_old"))
    row = F.coalesce(F.col("_new"), F.col("_old"))
    joined = old.join(new, keys, "full_outer").select(*keys, row.alias("_row"))
    return joined.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def purge(df: DataFrame, predicate: Column) -> DataFrame:
    """Delete rows for which the predicate is true; false and unknown stay."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))
