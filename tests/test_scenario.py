"""The workshop scenario of 27 orders: values that the original data must give."""

from __future__ import annotations

import datetime

import pytest

from tests.test_bucketed import rows_of
from wrenchline.operators import orders, reports
from wrenchline.schemas import (
    ACCEPTED, CLERK, MECHANIC, REFUSED, STATUS_DONE, STATUS_INTAKE, STATUS_REFUSED, STATUS_WAITING, STATUS_WORKING,
)

DAY = datetime.date(2017, 6, 1)
# Fixed values: (order, mechanic, hours, quote, final cost) of the scenario.
ORDERS = [
    (1, 1, 4, 255, 381), (2, 2, 2, 227, 300), (3, 3, 3, 234, 332), (4, 4, 5, 121, 258), (5, 1, 7, 229, 427),
    (6, 1, 6, 351, 536), (7, 2, 4, 154, 269), (8, 3, 1, 82, 115), (9, 4, 6, 253, 428), (10, 3, 5, 186, 330),
    (11, 1, 3, 126, 214), (12, 2, 1, 100, 135), (13, 3, 4, 90, 199), (14, 4, 5, 152, 292), (15, 1, 1, 31, 59),
    (16, 2, 1, 86, 120), (17, 3, 4, 130, 243), (18, 1, 3, 152, 242), (19, 2, 4, 170, 287), (20, 3, 1, 92, 126),
    (21, 1, 1, 82, 115), (22, 2, 5, 82, 215), (23, 4, 0, 136, 0), (24, 1, 0, 164, 0), (25, 2, 0, 110, 0),
    (26, 3, 0, 207, 0), (27, 4, 0, 0, 0)]
# The orders that are not done.
OTHERS = {23: STATUS_WORKING, 24: STATUS_WAITING, 25: STATUS_REFUSED, 26: STATUS_REFUSED, 27: STATUS_INTAKE}


@pytest.fixture(scope="module")
def scenario(spark):
    """(orders with quote and cost, lines, decisions); the quote of an order in two lines, one piece and some more."""
    jobs = spark.createDataFrame([(o, m, h, 0, None) for o, m, h, *_ in ORDERS],
                                 "order_id int, mechanic int, labor int, final_cost bigint, end_date date")
    lines = []
    for order, _, _, quote, _ in ORDERS:
        if quote:
            lines += [(order, f"{order}a", 30, 1, 1), (order, f"{order}b", quote - 30, 1, int(order != 24))]
    frame = spark.createDataFrame(lines, "order_id int, part_code string, price int, needed int, available int")
    decisions = spark.createDataFrame([(o, REFUSED if o in (25, 26, 27) else ACCEPTED) for o, *_ in ORDERS],
                                      "order_id int, outcome string")
    priced = orders.final_cost(orders.order_quote(jobs, frame), today=DAY).cache()
    return priced, frame, decisions


def test_quotes_and_costs(scenario):
    priced, *_ = scenario
    assert [(o, int(q), c) for o, q, c in rows_of(priced.select("order_id", "quote", "final_cost"))] == [
        (o, q, c) for o, _, _, q, c in ORDERS]
    assert {r.order_id for r in priced.filter("end_date IS NULL").collect()} == set(OTHERS)


def test_statuses(scenario):
    priced, lines, decisions = scenario
    want = [(o, OTHERS.get(o, STATUS_DONE)) for o, *_ in ORDERS]
    assert rows_of(orders.order_status(priced, lines, decisions)) == want
    assert rows_of(orders.priced_order_status(priced, lines, decisions)) == want


def test_balance(scenario):
    assert rows_of(orders.balance(scenario[0])) == [(2239,)]


def test_hours(spark, scenario):
    staff = spark.createDataFrame([(n, f"p{n}", MECHANIC if n < 5 else CLERK) for n in range(1, 6)],
                                  "staff_id int, person_id string, role string")
    people = spark.createDataFrame([(f"p{n}", f"name {n}") for n in range(1, 6)], "person_id string, first_name string")
    hours = reports.mechanic_hours(staff, people, scenario[0]).drop("first_name")
    assert rows_of(hours) == [(1, 25, 8), (2, 17, 7), (3, 18, 7), (4, 16, 5)]
    assert rows_of(reports.min_mechanic_hours(staff, people, scenario[0])) == [(16,)]
