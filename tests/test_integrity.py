from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, mismatch
from wrenchline.operators import gates, integrity
from wrenchline.plans.oracle import ORACLE
from wrenchline.plans.queries import QUERIES
from wrenchline.plans.shop_model import RAW_SCHEMAS
from wrenchline.schemas import FOREIGN_KEYS, Rule, declared_rules


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "people": spark.createDataFrame([("A",), ("B",)], "person_id string"),
        "staff": spark.createDataFrame([(1, "A", "Meccanico"), (2, "Z", "Cuoco"), (3, None, None)],
                                       "staff_id int, person_id string, role string"),
        "vehicles": spark.createDataFrame([("P1", "A"), ("P2", "B"), ("P2", "B"), (None, None)],
                                          "plate string, owner_id string"),
    }


def test_keys(tables):
    assert sorted((r.plate or "-", r.n) for r in integrity.audit_pk(tables["vehicles"], ["plate"]).collect()) == [
        ("-", 1), ("P2", 2)]
    assert integrity.audit_pk(tables["staff"], ["staff_id", "role"]).count() == 1  # the one with a NULL


def test_not_null_and_enum(tables):
    got = {r.column_name: r.nulls for r in integrity.audit_not_null(tables["staff"], ["staff_id", "role"]).collect()}
    assert got == {"staff_id": 0, "role": 1}
    assert [r.role for r in integrity.audit_enum(tables["staff"], "role", ["Meccanico"]).collect()] == ["Cuoco"]


def test_foreign_key_lets_null_pass(tables):
    orphans = integrity.audit_fk(tables["staff"], tables["people"], {"person_id": "person_id"})
    assert [r.person_id for r in orphans.collect()] == ["Z"]


def test_length_and_range(spark):
    df = spark.createDataFrame([("abc   ", 32767.4), ("abcd", 32767.5), (None, None)], "t string, n double")
    assert [r.t for r in integrity.audit_length(df, {"t": 3}).collect()] == ["abcd"]
    assert [r.n for r in integrity.audit_range(df, {"n": "smallint"}).collect()] == [32767.5]


def test_report_counts_every_rule(tables):
    rules = [Rule("key", "vehicles", ("plate",)), Rule("not_null", "staff", ("person_id", "role")),
             Rule("foreign_key", "staff", ("person_id",), "people", ("person_id",)),
             Rule("enum", "staff", ("role",), values=("Meccanico",)), Rule("length", "staff", ("role",), limit=5)]
    got = {r.rule: r.violations for r in integrity.constraint_report(tables, rules).collect()}
    assert got == {"key(plate)": 2, "not_null(person_id,role)": 1, "foreign_key(person_id)->people": 1,
                   "enum(role)": 1, "length(role)": 1}


def test_declared_rules_cover_the_model():
    kinds = {}
    for rule in declared_rules():
        kinds[rule.kind] = kinds.get(rule.kind, 0) + 1
    assert kinds["key"] == 9 and kinds["not_null"] == 9 and kinds["foreign_key"] == 9 and kinds["enum"] == 2


def test_renames_follow_the_foreign_keys(spark, tables):
    renames = spark.createDataFrame([("A", "A2"), ("Q", "Q2")], "old string, new string")
    got = integrity.cascade_tables(tables, "people", "person_id", renames, FOREIGN_KEYS)
    assert {r.person_id for r in got["people"].collect()} == {"A2", "B"}
    assert {r.person_id for r in got["staff"].collect()} == {"A2", "Z", None}
    assert {r.owner_id for r in got["vehicles"].collect()} == {"A2", "B", None}
    one = integrity.cascade_rename({"staff": (tables["staff"], "person_id")}, renames)
    assert {r.person_id for r in one["staff"].collect()} == {"A2", "Z", None}
    allowed, refused = integrity.restrict_rename(renames, tables["staff"], "person_id")
    assert [r.old for r in allowed.collect()] == ["Q"] and [r.old for r in refused.collect()] == ["A"]


def test_gates(spark):
    catalog = spark.createDataFrame([("1", "F", "M", "T"), ("2", "F", "M", "T"), ("3", "G", "M", "T")],
                                    "part_code string, brand string, model string, trim string")
    vehicles = spark.createDataFrame([("P1", "F", "M", "T"), ("P2", "F", "M", "X"), ("P3", "G", "M", None)],
                                     "plate string, brand string, model string, trim string")
    ok, bad = gates.vehicle_gate(vehicles, catalog)
    assert [r.plate for r in ok.collect()] == ["P1"]
    assert {(r.plate, r.reason) for r in bad.collect()} == {(p, "VEICOLO NON DISPONIBILE") for p in ("P2", "P3")}
    marked = {r.plate: r.reason is None for r in gates.marked_vehicles(vehicles, catalog).collect()}
    assert marked == {"P1": True, "P2": False, "P3": False}
    orders = spark.createDataFrame([(1, "P1"), (2, "P9")], "order_id int, plate string")
    lines = spark.createDataFrame([(1, "1"), (1, "3"), (2, "1"), (5, "1")], "order_id int, part_code string")
    ok, bad = gates.part_gate(lines, orders, vehicles, catalog)
    assert [(r.order_id, r.part_code) for r in ok.collect()] == [(1, "1")]
    assert sorted((r.order_id, r.part_code, r.reason) for r in bad.collect()) == [
        (1, "3", "PEZZO INCOMPATIBILE"), (2, "1", "PEZZO INCOMPATIBILE"), (5, "1", "PEZZO INCOMPATIBILE")]


def _pairs(spark, rows, schema="old int, new int"):
    return spark.createDataFrame(rows, schema)


def test_renames_at_once_swap_and_shift(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, v string")
    for rows, want in (([(1, 2), (2, 1)], {"a": 2, "b": 1, "c": 3, "d": None}),
                       ([(1, 2), (2, 3), (3, 9), (77, 1)], {"a": 2, "b": 3, "c": 9, "d": None})):
        got = integrity.cascade_tables({"t": table}, "t", "k", _pairs(spark, rows), [])["t"]
        assert {r.v: r.k for r in got.collect()} == want


@pytest.mark.parametrize("rows, message", [
    ([(1, 7), (1, 8)], "renamed twice: 1"), ([(1, 9), (2, 9)], "two keys become 9"), ([(1, 3)], "two keys become 3")])
def test_renames_that_clash_are_refused(spark, rows, message):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "second version")], "k int, v string")
    with pytest.raises(Exception, match=message):
        integrity.cascade_tables({"t": table}, "t", "k", _pairs(spark, rows), [])["t"].collect()


def test_renames_in_turn_against_one_after_the_other(spark):
    rng = random.Random(12)
    for _ in range(4):
        steps = [(s, rng.randrange(12), rng.randrange(12)) for s in rng.sample(range(500), 40)]
        want = {}
        for key in range(12):
            name = key
            for _, old, new in sorted(steps):
                name = new if name == old else name
            want[key] = name
        got = integrity.renames_in_turn(_pairs(spark, steps, "seq int, old int, new int"))
        mapping = {r.old: r.new for r in got.collect()}
        assert {key: mapping.get(key, key) for key in range(12)} == want
    assert integrity.renames_in_turn(_pairs(spark, [], "seq int, old int, new int")).count() == 0


def test_keys_merge_where_they_need_not_be_unique(spark):
    tables = {"t": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "second version")], "k int, v string"),
              "u": spark.createDataFrame([(1,), (3,), (None,)], "k int")}
    rules = [Rule("foreign_key", "u", ("k",), "t", parent_columns=("k",), on_update="cascade")]
    got = integrity.cascade_tables(tables, "t", "k", _pairs(spark, [(1, 3), (2, 3), (8, 9)]), rules, merge=True)
    assert sorted(r.v for r in got["t"].filter("k = 3").collect()) == ["a", "b", "c", "second version"]
    assert sorted(r.k or 0 for r in got["u"].collect()) == [0, 3, 3]
    with pytest.raises(Exception, match="renamed twice: 1"):
        integrity.cascade_tables(tables, "t", "k", _pairs(spark, [(1, 3), (1, 4)]), rules, merge=True)["t"].collect()


def test_renames_in_turn_by_all_names_a_key_had(spark):
    rng = random.Random(5)
    for _ in range(4):
        steps = [(s, rng.randrange(12), rng.randrange(12)) for s in rng.sample(range(500), 40)]
        want = {}
        for key in {old for _, old, new in steps if old != new}:
            names, ahead = {}, sorted(steps)
            first = next(s for s in ahead if s[1] == key and s[1] != s[2])
            names[first[2]], last = first[0], first[2]
            for seq, old, new in ahead:
                if old != new and names.get(old, seq) < seq:
                    names[new], last = min(names.get(new, seq), seq), new
            want[key] = last
        got = integrity.renames_in_turn(_pairs(spark, steps, "seq int, old int, new int"), aliases=True)
        assert {r.old: r.new for r in got.collect()} == want
    assert integrity.renames_in_turn(_pairs(spark, [], "seq int, old int, new int"), aliases=True).count() == 0


@pytest.mark.parametrize("name", ["cascade_rename", "cascade_rename_in_turn"])
def test_renames_of_parts_whose_new_codes_are_taken(spark, tmp_path, name):
    """Codes 0, 1, 2 and 3 million apart, as in tables of more than a million parts."""
    duck = duckdb.connect()
    rows = {
        "part": "SELECT c + 1000000 * k AS p_partkey, 'x' AS p_name, 'Brand#' || (c * (k + 3) % 4 + 1) AS p_brand, "
                "'T' AS p_type, 1::INT AS p_size, 5.0::DOUBLE AS p_retailprice FROM range(40) a(c), range(4) b(k)",
        "orders": "SELECT o AS o_orderkey, 1::BIGINT AS o_custkey, CASE WHEN o % 3 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus, "
                  "1.0::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, 'x' AS o_orderpriority FROM range(50) a(o)",
        "lineitem": "SELECT o AS l_orderkey, (o * 7 + n) % 40 + 1000000 * (n % 4) AS l_partkey, 1::BIGINT AS l_suppkey, "
                    "n::INT AS l_linenumber, 3.0::DOUBLE AS l_quantity, 2.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, "
                    "0.0::DOUBLE AS l_tax, 'N' AS l_returnflag, CASE WHEN n % 2 = 0 THEN 'O' ELSE 'F' END AS l_linestatus, "
                    "TIMESTAMP '2024-01-01' AS l_shipdate FROM range(50) a(o), range(9) b(n)"}
    kinds = {"timestamp_ntz": "TIMESTAMP"}
    for table, schema in RAW_SCHEMAS.items():
        nothing = ", ".join(f"NULL::{kinds.get(f.dataType.simpleString(), f.dataType.simpleString())} AS {f.name}" for f in schema)
        duck.execute(f"COPY ({rows.get(table, f'SELECT {nothing} WHERE false')}) TO '{tmp_path}/{table}.parquet'")
    assert mismatch(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), ORACLE[name]) == ""


def test_refused_renames_of_many_keys_stay_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        renames = spark.range(4000).select(F.col("id").alias("old"), (F.col("id") + 9000).alias("new")).unionByName(
            spark.sql("SELECT CAST(NULL AS BIGINT) AS old, 1L AS new"))
        child = spark.range(9000).select(F.when(F.col("id") < 8000, F.col("id") % 2000).alias("k"))
        allowed, refused = integrity.restrict_rename(renames, child, "k")
        assert allowed.columns == refused.columns == ["old", "new"]
        assert {r.old for r in refused.collect()} == set(range(2000)) and refused.count() == 2000
        assert {r.old for r in allowed.collect()} == {None, *range(2000, 4000)} and allowed.count() == 2001
        assert [df.rdd.getNumPartitions() for df in (allowed, refused)] == [4, 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
