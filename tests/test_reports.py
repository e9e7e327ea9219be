from __future__ import annotations

import pytest

from wrenchline.operators import reports

CATALOG = ("part_code string, version int, category string, name string, brand string, price int, supplier string")
ROWS = [
    ("9", 1, "Freni", "Disco", "A", 30, "S1"), ("10", 1, "Freni", "Pastiglia", "A", 20, "S1"),
    ("65", 1, "Motore", "Disco", "B", 50, "S2"),       # same name in a second category: code 9 wins
    ("65", 2, "Motore", "Disco bis", "B", 55, "S3"),
    ("70", 1, "Motore", "disco", "B", 5, "S1"),        # differs by case only
    ("71", 1, "Vetri", "Disco", "B", 5, "S2"),         # wins no name
    ("80", 1, "Luci", "Faro", "C", 9, "S4"), ("81", 1, "Gomme", "Ruota", "C", 9, "S4"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(ROWS, CATALOG)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(
        [(1, "9", "Disco", 5), (2, "9", "Disco", 1), (3, "65", "Ruota", 1), (4, "999", "Unknown", 1)],
        "order_id int, part_code string, name string, needed int")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_one_row_per_name_by_numeric_code(catalog):
    picked = {r.name: (r.part_code, r.category) for r in reports.parts_one_per_name(catalog).collect()}
    assert picked["Disco"] == ("9", "Freni")
    assert len(picked) == 6


def test_unused(catalog, lines):
    assert rows(reports.unused_parts(catalog, lines)) == [("Freni", 1), ("Luci", 1), ("Motore", 2)]
    assert rows(reports.unused_all_categories(catalog, lines)) == [
        ("Freni", 1), ("Gomme", None), ("Luci", 1), ("Motore", 2), ("Vetri", None)]


def test_used(catalog, lines):
    assert rows(reports.used_all_categories(catalog, lines)) == [
        ("Freni", 1), ("Gomme", 1), ("Luci", None), ("Motore", None), ("Vetri", None)]


def test_usage_in_one_table(catalog, lines):
    assert rows(reports.category_usage(catalog, lines)) == [
        ("Freni", 1, 1, 2), ("Gomme", 1, None, 1), ("Luci", None, 1, 1), ("Motore", None, 2, 2)]
    assert rows(reports.names_by_category(catalog)) == [("Freni", 2), ("Gomme", 1), ("Luci", 1), ("Motore", 2)]


def test_names_ignoring_case(catalog, lines):
    usage = rows(reports.category_usage(catalog, lines, collation="UTF8_LCASE"))
    assert usage == [("Freni", 1, 1, 2), ("Gomme", 1, None, 1), ("Luci", None, 1, 1), ("Motore", None, 1, 1)]


def test_line_without_name_makes_nothing_unused(spark, catalog, lines):
    with_null = lines.unionByName(spark.createDataFrame([(5, "9", None, 1)], lines.schema))
    assert rows(reports.unused_parts(catalog, with_null)) == []
    assert {r.unused for r in reports.category_usage(catalog, with_null).collect()} == {None}


def test_revenue_ignores_quantity(catalog, lines):
    assert rows(reports.supplier_revenue(lines, catalog)) == [("S1", "A", 60, 2), ("S2", "B", 50, 1)]


def test_hours(spark):
    staff = spark.createDataFrame([(1, "p1", "Meccanico"), (2, "p2", "Meccanico"), (3, "p3", "Segretario"),
                                   (4, None, "Meccanico")], "staff_id int, person_id string, role string")
    people = spark.createDataFrame([("p1", "Ada"), ("p2", "Bo"), ("p3", "Cy")], "person_id string, first_name string")
    orders = spark.createDataFrame([(1, 1, 4), (2, 1, 0), (3, 2, 3), (4, 3, 9), (5, 4, 1), (6, None, 8)],
                                   "order_id int, mechanic int, labor int")
    got = sorted(rows(reports.mechanic_hours(staff, people, orders)))
    assert got == [(1, "Ada", 4, 2), (2, "Bo", 3, 1)]
    assert reports.min_mechanic_hours(staff, people, orders).first().min_hours == 3
