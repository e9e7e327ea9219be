"""A shop day of batches against the same events one by one, and the routines as SQL functions."""

from __future__ import annotations

import datetime

import pytest

from tests.simulator import Line, Simulator
from wrenchline.functions import sql_functions
from wrenchline.plans import shop_day
from wrenchline.schemas import SCHEMAS

DAY = datetime.date(2024, 3, 1)
LATER = datetime.date(2024, 3, 9)
VEHICLES = [("AA1", "F"), ("BB2", "F"), ("CC3", "G"), ("DD4", "H"), ("EE5", "G"), ("GG6", "F")]
PARTS = [("9", "F"), ("65", "F"), ("98", "F"), ("65", "G"), ("200", "G")]
# (order, part, quantity, price, day)
LINES = [(1, "9", 2, 40, 0), (1, "65", 1, 35, 0), (2, "65", 2, 31, 1), (2, "98", 1, 38, 1), (3, "200", 4, 55, 1),
         (3, "65", 1, 30, 2), (4, "200", 2, 55, 3), (4, "9", 1, 40, 3), (5, "65", 3, 35, 4)]
DECISIONS = [(1, "Positivo"), (2, "Positivo"), (3, "Negativo"), (3, "Positivo"), (4, "Negativo"), (5, "Positivo")]
RECEIPTS = [("9", 2), ("65", 2), ("65", 1), ("200", 9), ("98", 1), ("65", 2), ("200", 4), ("300", 1)]
LABOR = [(1, 3), (2, 5), (1, 4)]


@pytest.fixture(scope="module")
def shop(spark):
    """(tables, simulator, rejected vehicles, rejected lines, receipt decisions) after the day."""
    sim = Simulator(suppliers={p: f"S{p}" for p, _ in PARTS}, fits=set(PARTS), mechanics=[1, 2, 3])
    tables = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    tables["staff"] = spark.createDataFrame([(n, f"p{n}", "Meccanico") for n in (1, 2, 3)] +
                                            [(4, "p4", "Segretario")], SCHEMAS["staff"])
    versioned = [(p, PARTS[:i].count((p, "F")) + [q for q, _ in PARTS[:i]].count(p) + 1, "Cat", f"N{p}", m, "M", "T", 1,
                  f"S{p}") for i, (p, m) in enumerate(PARTS)]
    tables["catalog"] = spark.createDataFrame(versioned, SCHEMAS["catalog"])

    vehicles = spark.createDataFrame([(p, m, "M", "T", "x") for p, m in VEHICLES], SCHEMAS["vehicles"])
    tables, bad_vehicles = shop_day.take_vehicles(tables, vehicles)
    for plate, model in VEHICLES:
        sim.arrive(plate, model)
    plates = [p for p, m in VEHICLES if m != "H"]
    requests = spark.createDataFrame([(p, DAY, n) for n, p in enumerate(plates)],
                                     "plate string, start_date date, n int")
    tables = shop_day.open_orders(tables, requests, ["n"])
    for plate in plates:
        sim.open(plate)
    days = [DAY + datetime.timedelta(days=d) for *_, d in LINES]
    lines = spark.createDataFrame([(o, p, f"N{p}", q, 0, price, day)
                                   for (o, p, q, price, _), day in zip(LINES, days)], SCHEMAS["lines"])
    tables, bad_lines = shop_day.add_lines(tables, lines, DAY)
    for (o, p, q, price, _), day in zip(LINES, days):
        sim.add_line(Line(o, p, 0, q, 0, price, day), DAY)
    updates = spark.createDataFrame([(o, r, n) for n, (o, r) in enumerate(DECISIONS)],
                                    "order_id int, outcome string, seq int")
    tables = shop_day.apply_decisions(tables, updates)
    for order, outcome in DECISIONS:
        sim.decide(order, outcome)
    receipts = spark.createDataFrame([(p, n, a) for n, (p, a) in enumerate(RECEIPTS)],
                                     "part_code string, seq int, arrived int")
    tables, decided = shop_day.receive_goods(tables, receipts)
    for part, arrived in RECEIPTS:
        sim.receive(part, arrived)
    labor = spark.createDataFrame([(o, h, n) for n, (o, h) in enumerate(LABOR)], "order_id int, labor int, seq int")
    tables = shop_day.record_labor(tables, labor, LATER)
    for order, hours in LABOR:
        sim.work(order, hours, LATER)
    return {k: v.cache() for k, v in tables.items()}, sim, bad_vehicles, bad_lines, decided


def test_rejections(shop):
    _, _, vehicles, lines, _ = shop
    assert [r.plate for r in vehicles.collect()] == ["DD4"]
    assert [(r.order_id, r.part_code) for r in lines.collect()] == [(4, "9")]


def test_orders(shop):
    tables, sim, *_ = shop
    got = {r.order_id: (r.mechanic, r.labor, r.quote, r.final_cost, r.end_date) for r in tables["orders"].collect()}
    assert got == {n: (o["mechanic"], o["labor"], o["quote"], o["cost"], o["end"]) for n, o in sim.orders.items()}


def test_stock_and_lines(shop):
    tables, sim, *_, decided = shop
    assert {r.part_code: r.quantity for r in tables["pending"].collect()} == {p: q for p, (q, _) in sim.pending.items()}
    assert sorted((r.order_id, r.part_code, r.available) for r in tables["lines"].collect()) == sorted(
        (x.order_id, x.part_code, x.available) for x in sim.lines)
    assert {r.seq: r.outcome for r in decided.collect()}[7] == "refused: part not on order"


def test_decisions_and_status(shop):
    tables, sim, *_ = shop
    assert {r.order_id: r.outcome for r in tables["decisions"].collect()} == sim.decisions
    got = {r.order_id: r.status for r in shop_day.statuses(tables).collect()}
    assert got == {n: sim.status(n) for n in sim.orders}
    assert len(set(got.values())) >= 3


def test_arriving_vehicle_clears_finished_stock(spark, shop):
    tables, sim, *_ = shop
    late = spark.createDataFrame([("ZZ9", "F", "M", "T", "x")], SCHEMAS["vehicles"])
    after, _ = shop_day.take_vehicles(tables, late)
    assert {r.part_code for r in after["pending"].collect()} == {p for p, (q, _) in sim.pending.items() if q}
    unknown = spark.createDataFrame([("ZZ9", "?", "M", "T", "x")], SCHEMAS["vehicles"])
    after, _ = shop_day.take_vehicles(tables, unknown)
    assert after["pending"].count() == len(sim.pending)


def test_sql_functions(spark, shop):
    tables, sim, *_ = shop
    sql_functions.register(spark, tables)
    assert spark.sql("SELECT quantity_left(3, 10), quantity_left(10, 3), quantity_left(3, 3), "
                     "quantity_left(1, NULL)").first()[:] == (7, 3, 0, 0)
    asked = [(part, arrived) for part in [*sim.pending, "?"] for arrived in (0, 1, 2, 50)]
    spark.createDataFrame(asked, "part_code string, arrived bigint").createOrReplaceTempView("asked")
    got = spark.sql("SELECT part_code, arrived, Ricevuti(arrived, part_code) AS rest FROM asked").collect()
    for r in got:
        before = sim.pending[r.part_code][0] if r.part_code in sim.pending else 0
        assert r.rest == (before if before < r.arrived else before - r.arrived), r
    row = spark.sql("SELECT Saldo() AS s, prossimo() AS p, Meccanico() AS m").first()
    closed = [o for o in sim.orders.values() if o["labor"]]
    share = round(sum(o["quote"] for o in closed) / 10 + 1e-9)
    assert row.s == share + 25 * sum(o["labor"] for o in closed)
    assert row.p == max(sim.orders) + 1 and row.m == sim.choose()
    got = {r.order_id: r.s for r in spark.sql("SELECT order_id, StatoOrdine(order_id) AS s FROM orders").collect()}
    assert got == {n: sim.status(n) for n in sim.orders}
    want = sim.recent("65", 3)
    assert spark.sql("SELECT limite('65', 3) AS k").first().k == len(want)
    got = [tuple(r) for r in spark.sql("SELECT * FROM Assegnazioni(3, '65')").collect()]
    assert sorted(got) == sorted((x.order_id, x.available, i + 1) for i, x in enumerate(want))


def test_queries_by_original_names(spark, shop):
    tables, sim, *_ = shop
    sql_functions.register_original_views(spark, tables)
    sql_functions.register(spark, tables)
    rows = spark.sql("SELECT NROrdine, StatoOrdine(NROrdine) AS Stato FROM StoricoOrdine").collect()
    assert {r.NROrdine: r.Stato for r in rows} == {n: sim.status(n) for n in sim.orders}
    hours = spark.sql("""SELECT I.Matricola, SUM(S.Manodopera) AS OreTotali, count(NROrdine) AS OrdiniTotali
        FROM Dipendente I JOIN StoricoOrdine S ON I.Matricola = S.Meccanico GROUP BY I.Matricola""")
    assert sum(r.OrdiniTotali for r in hours.collect()) == len(sim.orders)
