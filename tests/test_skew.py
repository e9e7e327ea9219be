from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wrenchline.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share key 7, some have no key."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 50 == 1, None).otherwise(n % 101)
    return spark.range(6000).select(key.alias("key"), (n * 37 % 6007).alias("pos"), (n % 5).alias("value"))


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_hot_keys_are_found(hot_spark, rows):
    hot_spark.conf.set("wrenchline.skew.hotRows", "500")
    assert len(skew.hot_keys(rows, ["key"])) == 1
    hot_spark.conf.set("wrenchline.skew.hotRows", "5000")
    assert skew.hot_keys(rows, ["key"]) == []


def test_small_input_needs_no_detection(spark, rows):
    assert skew.hot_keys(rows, ["key"]) == []


@pytest.mark.parametrize("limit", ["50", "500"])
def test_running_totals_on_both_routes(hot_spark, rows, limit):
    hot_spark.conf.set("wrenchline.skew.hotRows", limit)
    order = [F.col("pos").desc()]
    upto = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"total": F.sum("value").over(upto), "nr": F.row_number().over(upto).cast("bigint")})
    got = skew.running_totals(rows, ["key"], order, {"total": F.col("value"), "nr": F.lit(1)})
    assert as_set(got) == as_set(want)


def test_slices_split_a_group(spark, rows):
    """Without any key all rows form one group; it must still be spread over several slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = skew.sliced_totals(rows, [], [F.col("pos")], {"nr": F.lit(1)})
        assert got.rdd.getNumPartitions() > 1
        ranked = got.orderBy("pos").select("nr").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.nr for r in ranked] == list(range(1, 6001))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_on_both_routes(hot_spark, rows, how):
    names = hot_spark.range(0, 60).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    want = rows.join(names, ["key"], how)
    hot_spark.conf.set("wrenchline.skew.hotRows", "100")
    assert as_set(skew.lookup_join(rows, names, ["key"], how)) == as_set(want)


def test_key_maximum_on_both_routes(hot_spark, rows):
    hot_spark.conf.set("wrenchline.skew.hotRows", "500")
    keyed = rows.dropna()
    want = keyed.withColumn("top", F.max("pos").over(Window.partitionBy("key")))
    got = skew.by_route(keyed, ["key"], lambda part, route: route.key_maximum(part, F.col("pos"), "top"))
    assert skew.hot_keys(keyed, ["key"]) and as_set(got) == as_set(want)


def test_not_in_follows_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(2,)], "b int")
    with_null = spark.createDataFrame([(2,), (None,)], "b int")
    assert [r.a for r in skew.not_in(left, "a", right, "b").collect()] == [1]
    assert skew.not_in(left, "a", with_null, "b").collect() == []
    assert skew.not_in(left, "a", right.filter("b > 5"), "b").count() == 3


def test_small_sides(spark, monkeypatch):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,), (2,), (3,)]), "a int")
    assert skew.plan_bytes(unknown) >= skew.UNKNOWN_BYTES
    assert hinted(skew.sized(unknown)) and hinted(skew.sized(spark.range(3)))
    assert not skew.is_small(spark.range(10_000_000))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    assert not hinted(skew.sized(unknown))


def test_known_inputs_are_sized_without_a_job(spark):
    """The estimate of a join of known inputs is a product, far beyond any table; it must not be taken for unknown."""
    left = spark.range(200_000_000).withColumn("x", F.col("id") + 1)
    joined = left.join(spark.range(200_000_000), "id").join(spark.range(100_000_000), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        assert skew.plan_bytes(joined) > skew.UNKNOWN_BYTES and skew.inputs_known(joined)
        spark.sparkContext.setJobGroup("sizing", "no job")
        assert not skew.is_small(joined)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("sizing")
        unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "id bigint")
        assert not skew.inputs_known(unknown) and skew.is_small(unknown)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_slices_grow_with_the_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "SLICE_ROWS", 500)
    got = skew.sliced_totals(rows, ["key"], [F.col("pos")], {"total": F.col("value")})
    plain = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    assert as_set(got) == as_set(rows.withColumn("total", F.sum("value").over(plain)))
