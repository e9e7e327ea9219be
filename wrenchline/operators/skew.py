"""Joins and running totals that survive a key holding a large share of all rows.

Detection: one aggregate with a bounded sketch (``approx_top_k``) over the key column returns the few keys
above ``wrenchline.skew.hotRows`` rows. It is skipped when the optimizer's size estimate of the input is below
``wrenchline.skew.minBytes``: such an input fits in a task whatever its keys are. Detection only chooses the
physical route; both routes give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenchline.session import pinned

HOT_ROWS = ("wrenchline.skew.hotRows", 2_000_000)
MIN_BYTES = ("wrenchline.skew.minBytes", 64 << 20)
# Bound on the number of hot keys, hence on everything broadcast "per hot key" below.
MAX_HOT_KEYS = 10_000
# Rows of a table with one short row per key that may be broadcast after counting them, some 10 MB; of wider rows only
# as many as make BROADCAST_BYTES by the default sizes of their types. Above, the side is joined without a broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
# An input with an estimate at least this large, such as a micro-batch, has no known size.
UNKNOWN_BYTES = 1 << 60
# Rows of a slice of ``sliced_totals``.
SLICE_ROWS = 1_000_000
# Keys the sketch tracks: any key above about 1/75,000 of all rows is found.
SKETCH_ITEMS = 100_000


def _setting(spark: SparkSession, setting: tuple[str, int]) -> int:
    return int(spark.conf.get(setting[0], str(setting[1])))


def plan_bytes(df: DataFrame) -> int:
    """Size of the result as the optimizer estimates it (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def inputs_known(df: DataFrame) -> bool:
    """Whether the optimizer knows the size of every input. The estimate of a join is the product of its sides and
    says nothing about that, however large it is."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return all(size < UNKNOWN_BYTES for size in sizes)


def is_small(df: DataFrame) -> bool:
    """Whether a lookup side may be broadcast: by Spark's own size threshold, or, only where an input has no known
    size, by counting rows up to a bound. With known inputs nothing is executed."""
    if plan_bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return True
    if inputs_known(df):
        return False
    width = max(1, df._jdf.schema().defaultSize())
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // width)
    return df.limit(most + 1).count() <= most


def sized(df: DataFrame) -> DataFrame:
    """Mark a small lookup side for broadcast, so that a handful of events never makes a join shuffle its
    whole other side."""
    return F.broadcast(df) if is_small(df) else df


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that hold more than ``hotRows`` rows; at most ``MAX_HOT_KEYS``."""
    spark = df.sparkSession
    if plan_bytes(df) < _setting(spark, MIN_BYTES):
        return []
    sketch = F.expr(f"approx_top_k(_h, {MAX_HOT_KEYS}, {SKETCH_ITEMS})")
    top = df.select(key_hash(keys).alias("_h")).agg(sketch.alias("top")).first()["top"]
    limit = _setting(spark, HOT_ROWS)
    return [item["item"] for item in top or [] if item["count"] > limit]


def part_by_heat(df: DataFrame, keys: Sequence[str], hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of hot keys."""
    is_hot = key_hash(keys).isin(hot)
    return df.filter(~is_hot), df.filter(is_hot)


class Ordinary:
    """Steps on rows whose keys each fit in a task: hash shuffles by key, which following steps share."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def join(self, left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """The join Spark plans; AQE broadcasts a side only below its own size threshold."""
        return left.join(right, self.keys, how)

    def running_totals(self, df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
        """Inclusive running sums per key, in ``order``, which must be unique within a key."""
        upto_here = Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value.cast("bigint")).over(upto_here) for name, value in totals.items()})

    def key_maximum(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        """Add the largest ``value`` of the row's key."""
        return df.withColumn(out, F.max(value).over(Window.partitionBy(*self.keys)))


class Hot(Ordinary):
    """The same steps on rows of hot keys, which are never gathered by key.

    There are at most ``MAX_HOT_KEYS`` keys, so a table with one row per key is broadcast.
    """

    def __init__(self, keys: Sequence[str], hot: list[int]):
        super().__init__(keys)
        self.hot = hot

    def join(self, left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        _, right = part_by_heat(right, self.keys, self.hot)
        if how in ("left_semi", "left_anti"):
            right = right.select(*self.keys).distinct()
        return left.join(F.broadcast(right), self.keys, how)

    def running_totals(self, df: DataFrame, order: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
        return sliced_totals(df, self.keys, order, totals)

    def key_maximum(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        tops = df.groupBy(*self.keys).agg(F.max(value).alias(out))
        return df.join(F.broadcast(tops), self.keys, "left")


def by_route(df: DataFrame, keys: Sequence[str], steps: Callable[[DataFrame, Ordinary], DataFrame],
             hot: list[int] | None = None) -> DataFrame:
    """Apply ``steps(rows, route)`` to the rows of ordinary and of hot keys apart, and put the results together.

    A right side given to ``route.join`` must have at most one row per key, or any number for semi and anti joins.
    """
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return steps(df, Ordinary(keys))
    cold, warm = part_by_heat(df, keys, hot)
    return steps(cold, Ordinary(keys)).unionByName(steps(warm, Hot(keys, hot)))


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
                hot: list[int] | None = None) -> DataFrame:
    """Equi-join in which ``right`` has at most one row per key (any number for semi and anti joins).

    A small ``right`` is broadcast, and then no key is hot. Otherwise see ``by_route``.
    """
    if hot is None and is_small(right):
        return left.join(F.broadcast(right), list(on), how)
    return by_route(left, list(on), lambda rows, route: route.join(rows, right, how), hot)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   totals: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums per key, see ``Ordinary.running_totals``."""
    return by_route(df, keys, lambda rows, route: route.running_totals(rows, order, totals))


def sliced_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  totals: Mapping[str, Column]) -> DataFrame:
    """Running sums with no task holding a whole group.

    A range shuffle cuts the sorted rows into slices of about ``SLICE_ROWS`` rows, whatever the keys are; each slice
    sums its own rows, and the sums of earlier slices of the same key are added as an offset. There are
    at most (slices + keys) offsets, so they are broadcast. The slice number is stored by a checkpoint because
    range bounds are sampled anew on every evaluation.
    """
    keys = list(keys)
    values = {f"_v_{name}": value.cast("bigint") for name, value in totals.items()}
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(least, -(-df.count() // SLICE_ROWS))
    ranged = df.withColumns(values).repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    placed = pinned(ranged.withColumn("_slice", F.spark_partition_id()))
    per_slice = placed.groupBy(*keys, "_slice").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{v}") for v in values])
    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_slice") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = placed.join(F.broadcast(offsets), same, "left")
    return joined.withColumns(
        {name: F.sum(f"_v_{name}").over(inside) + F.col(f"_o_v_{name}") for name in totals}
    ).select(*df.columns, *totals)


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``left_key NOT IN (SELECT right_key …)`` with SQL's NULL rules, without a forced broadcast.

    A NULL on the right empties the result; a NULL on the left passes only when the right side is empty.
    Keys are expected to be about unique on the left, as names and ids are, so they are not searched for hot ones.
    """
    values = right.select(F.col(right_key).alias(left_key))
    has_null = values.filter(F.col(left_key).isNull()).exists()
    kept = left.filter(~has_null).filter(F.col(left_key).isNotNull() | ~values.exists())
    return kept.join(values.filter(F.col(left_key).isNotNull()).distinct(), left_key, "left_anti")
