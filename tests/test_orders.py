from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wrenchline.operators import orders

TODAY = datetime.date(2024, 5, 2)
OLD = datetime.date(2024, 1, 1)
ORDER = "order_id int, labor int, quote int, final_cost int, end_date date"


def test_cost_rounds_half_up_and_skips_open_orders(spark):
    df = spark.createDataFrame([(1, 4, 255, 0, None), (2, 0, 100, 7, OLD), (3, None, 100, 7, None),
                                (4, 1, 5, 0, OLD)], ORDER)
    got = {r.order_id: (r.final_cost, r.end_date) for r in orders.final_cost(df, today=TODAY).collect()}
    assert got == {1: (381, TODAY), 2: (7, OLD), 3: (7, None), 4: (31, TODAY)}  # 380.5 and 30.5


def test_cost_of_changed_orders_only(spark):
    df = spark.createDataFrame([(1, 4, 255, 0, None), (2, 4, 255, 9, OLD)], ORDER)
    got = orders.final_cost(df, today=TODAY, changed=F.col("order_id") == 1)
    assert {r.order_id: r.final_cost for r in got.collect()} == {1: 381, 2: 9}


def test_cost_uses_the_current_date(spark):
    df = spark.createDataFrame([(1, 4, 255, 0, None)], ORDER)
    row = orders.final_cost(df).withColumn("same", F.col("end_date") == F.current_date()).first()
    assert row.same


LINES = "order_id int, needed int, price int"


def test_quote_uses_line_prices(spark):
    lines = spark.createDataFrame([(1, 2, 40), (1, 1, 31), (2, 3, None)], LINES)
    df = spark.createDataFrame([(1,), (2,), (3,)], "order_id int")
    loose = {r.order_id: r.quote for r in orders.order_quote(df, lines).collect()}
    strict = {r.order_id: r.quote for r in orders.order_quote(df, lines, strict_null=True).collect()}
    assert loose == {1: 111, 2: 0, 3: 0}
    assert strict == {1: 111, 2: None, 3: 0}
    more = spark.createDataFrame([(3, 2, 5), (1, 1, 1), (1, 1, 1)], LINES)
    grown = orders.quote_delta(orders.order_quote(df, lines), more)
    assert {r.order_id: r.quote for r in grown.collect()} == {1: 113, 2: 0, 3: 10}


def test_status_of_every_kind(spark):
    df = spark.createDataFrame(
        [(1, 0), (2, 0), (3, 0), (4, 0), (5, 9), (6, 9), (7, None), (8, 0)], "order_id int, final_cost int")
    lines = spark.createDataFrame(
        [(2, 1, 0), (3, 1, 0), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 0), (7, None, None), (8, 2, 1), (8, 1, 2)],
        "order_id int, needed int, available int")
    decisions = spark.createDataFrame(
        [(1, "Negativo"), (2, "Negativo"), (3, "Positivo"), (4, "Positivo"), (5, "Positivo")],
        "order_id int, outcome string")
    got = {r.order_id: r.status for r in orders.order_status(df, lines, decisions).collect()}
    assert got == {1: "ACCETTAZIONE", 2: "PREVENTIVO NON ACCETTATO", 3: "IN ATTESA PEZZI", 4: "IN LAVORAZIONE",
                   5: "CONCLUSO", 6: "IN ATTESA PEZZI", 7: "CONCLUSO", 8: "IN LAVORAZIONE"}


def test_balance(spark):
    df = spark.createDataFrame([(2, 100), (3, 135), (0, 999), (None, 5)], "labor int, quote int")
    assert orders.balance(df).first().balance == 24 + 125  # 23.5 rounds up
    assert orders.balance(df.filter("labor = 0")).first().balance is None


def test_remaining(spark):
    pending = spark.createDataFrame([("1", 5), ("2", 5)], "part_code string, quantity int")
    receipts = spark.createDataFrame([("1", 3), ("1", 5), ("1", 9), ("2", None), ("3", 1), ("2", -2)],
                                     "part_code string, arrived int")
    got = sorted((r.part_code, r.arrived or 99, r.remaining) for r in
                 orders.receipt_remaining(pending, receipts).collect())
    assert got == sorted([("1", 3, 2), ("1", 5, 0), ("1", 9, 5), ("2", 99, 0), ("3", 1, 0), ("2", -2, 7)])


def test_decisions(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "order_id int")
    known = spark.createDataFrame([(1, "Positivo")], "order_id int, outcome string")
    full = orders.default_decision(df, known)
    updates = spark.createDataFrame([(2, "Positivo", 1), (2, "Negativo", 2), (3, "Positivo", 4), (9, "Positivo", 5)],
                                    "order_id int, outcome string, seq int")
    got = {r.order_id: r.outcome for r in orders.decide(full, updates).collect()}
    assert got == {1: "Positivo", 2: "Negativo", 3: "Positivo"}


def test_next_ids(spark):
    new = spark.createDataFrame([("b", 2), ("a", 9), ("c", 1)], "plate string, n int")
    none = spark.createDataFrame([], "order_id int")
    some = spark.createDataFrame([(4,), (41,)], "order_id int")
    assert {r.plate: r.order_id for r in orders.next_ids(new, none, "order_id", ["n"]).collect()} == {
        "c": 1, "b": 2, "a": 3}
    assert sorted(r.order_id for r in orders.next_ids(new, some, "order_id", ["plate"]).collect()) == [42, 43, 44]
