from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from wrenchline.operators import maintenance
from wrenchline.schemas import DEFAULTS, SCHEMAS
from wrenchline.sources import tables, versions


@pytest.fixture()
def folder(tmp_path):
    return f"file:{tmp_path}"


def test_positional_rows_of_integers_as_text(spark):
    raw = spark.createDataFrame([("1", "168", "Disco ", "2", "0", "40", "2017-05-25"),
                                 ("2", "9", "Filtro", "2.5", None, "40", "2017-05-25"),
                                 ("3", "9", "Filtro", "99999", "0", "40", "2017-05-25"),
                                 ("4", "9", "Filtro", "1", "0", "40", "2017-02-30"),
                                 ("x", "9", None, "1", "0", "40", "2017-05-25")],
                                "a string, b string, c string, d string, e string, f string, g string")
    good, bad = tables.ingest_rows(raw, SCHEMAS["lines"], positional=True)
    assert good.schema.simpleString() == "struct<order_id:int,part_code:string,name:string,needed:smallint," \
                                         "available:smallint,price:int,requested:date>"
    assert [tuple(r) for r in good.orderBy("order_id").collect()] == [
        (1, "168", "Disco", 2, 0, 40, datetime.date(2017, 5, 25)),
        (2, "9", "Filtro", 3, None, 40, datetime.date(2017, 5, 25))]
    assert {r.order_id: r.problem for r in bad.collect()} == {
        "3": "needed not smallint", "4": "requested not date", "x": "order_id not int; name is null"}


def test_column_list_takes_defaults(spark):
    raw = spark.createDataFrame([("7", "P1", "2", "2017-05-25")],
                                "order_id string, plate string, mechanic string, start_date string")
    good, bad = tables.ingest_rows(raw, SCHEMAS["orders"], defaults=DEFAULTS["orders"])
    row = good.first()
    assert (row.order_id, row.labor, row.quote, row.final_cost, row.end_date) == (7, 0, 0, 0, None)
    assert bad.count() == 0
    nulls = good.withColumn("labor", F.lit(None).cast("smallint"))
    assert tables.apply_defaults(nulls, DEFAULTS["orders"]).first().labor == 0


def test_original_names_round_trip(spark):
    raw = spark.createDataFrame([("7", 4, "S")], "CodicePezzo string, Quantita int, Fornitore string")
    renamed = tables.from_original_names(raw, "pending")
    assert renamed.columns == ["part_code", "quantity", "supplier"]
    assert tables.to_original_names(renamed, "pending").columns == raw.columns


def test_load_tables_with_declared_schema(spark, folder):
    for name in ("pending", "decisions"):
        data = {"pending": [("7", 1, "S")], "decisions": [(1, "Positivo")]}[name]
        spark.createDataFrame(data, SCHEMAS[name]).write.option("header", True).csv(f"{folder}/{name}")
    chosen = {name: SCHEMAS[name] for name in ("pending", "decisions")}
    loaded = tables.load_tables(spark, folder, chosen, fmt="csv", header="true")
    assert loaded["pending"].first().quantity == 1
    assert tables.scan(loaded["decisions"], ["outcome"]).columns == ["outcome"]


def test_replace_keeps_the_old_version_readable(spark, folder):
    first = tables.replace_table(spark.range(3).toDF("n"), f"{folder}/t")
    second = tables.replace_table(first.filter("n > 0"), f"{folder}/t")
    assert first.count() == 3 and second.count() == 2
    assert versions.read_version(spark, f"{folder}/t").count() == 2
    split = tables.replace_table(second.withColumn("k", F.col("n") % 2), f"{folder}/p", ["k"])
    assert sorted(map(tuple, split.collect())) == [(1, 1), (2, 0)]


def test_versions_are_written_once_and_pruned(spark, folder):
    path = f"{folder}/v"
    assert versions.read_version(spark, path) is None
    for number in range(5):
        versions.write_version(spark.range(number + 1), path, number)
    versions.write_version(spark.range(99), path, 4)
    assert versions.versions(spark, path) == [2, 3, 4]
    assert versions.read_version(spark, path).count() == 5
    assert versions.read_version(spark, path, 3).count() == 4
    with pytest.raises(ValueError):
        versions.write_version(spark.range(1), path, 3)


def test_an_unfinished_version_is_not_current(spark, folder):
    path = f"{folder}/u"
    versions.write_version(spark.range(2), path, 1)
    spark.range(7).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/v=2")
    assert versions.read_version(spark, path).count() == 2
    versions.write_version(spark.range(3), path, 2)
    assert versions.read_version(spark, path).count() == 3


def test_stage_and_append(spark, folder):
    staged = tables.stage(spark.range(4).toDF("n"), "staged_numbers")
    assert spark.sql("SELECT sum(n) AS s FROM staged_numbers").first().s == 6
    staged.unpersist()
    target = spark.range(2).toDF("n")
    assert tables.append_query(target, spark.range(3).selectExpr("cast(id as int) as n")).count() == 5
    tables.append_query(f"{folder}/a", target)
    tables.append_query(f"{folder}/a", target)
    assert spark.read.parquet(f"{folder}/a").count() == 4


def test_last_patch_wins_and_may_set_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int")
    patches = spark.createDataFrame([(1, 50, 1), (1, None, 2), (2, None, 1), (2, 60, 2), (9, 1, 1)],
                                    "k int, v int, seq int")
    assert {r.k: r.v for r in maintenance.update_by_key(df, patches, ["k"], "seq").collect()} == {1: None, 2: 60, 3: 7}


def test_upserts(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k int, q int, s string")
    deltas = spark.createDataFrame([(2, 1, "x"), (3, 2, "z"), (3, 2, "y")], "k int, q int, s string")
    added = sorted(map(tuple, maintenance.upsert(df, deltas, ["k"], ["q"]).collect()))
    assert added == [(1, 5, "a"), (2, 7, "b"), (3, 4, "y")]
    replaced = sorted(map(tuple, maintenance.upsert(df, deltas.limit(1), ["k"]).collect()))
    assert replaced == [(1, 5, "a"), (2, 1, "x")]
    grown = maintenance.increment_by_key(df, deltas, ["k"], "q")
    assert sorted(map(tuple, grown.collect())) == [(1, 5, "a"), (2, 7, "b")]


def test_purge_keeps_unknown(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "q int")
    assert maintenance.purge(df, F.col("q") == 0).count() == 2


def test_an_unknown_quantity_stays_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, q bigint")
    deltas = spark.createDataFrame([(1, 2), (2, None), (2, 1), (3, None), (4, 7)], "k int, q bigint")
    added = {r.k: r.q for r in maintenance.upsert(df, deltas, ["k"], ["q"]).collect()}
    assert added == {1: None, 2: 6, 3: None, 4: 7}
    assert {r.k: r.q for r in maintenance.increment_by_key(df, deltas, ["k"], "q").collect()} == {1: None, 2: 6}
