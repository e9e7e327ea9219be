"""Matching of arrivals against the one-event-at-a-time rules, on random small cases."""

from __future__ import annotations

import datetime
import random

import pytest

from tests.simulator import Line, Simulator
from wrenchline.operators import stock

LINES = "order_id bigint, part_code bigint, line_no int, needed bigint, available bigint, price bigint, requested date"
DAY = datetime.date(2024, 3, 1)


def random_case(seed: int):
    rng = random.Random(seed)
    sim = Simulator(suppliers={p: f"S{p % 3}" for p in range(9)})
    for order in range(1, 90):
        for number in range(rng.randint(0, 3)):
            part = 4 if rng.random() < 0.35 else rng.randint(0, 8)
            needed = rng.choice([0, 1, 1, 2, 3, 4])
            sim.lines.append(Line(order, part, number, needed, rng.choice([0, 0, needed]), 10,
                                  DAY + datetime.timedelta(days=rng.randint(0, 20))))
    sim.lines = [x for x in sim.lines if x.part_code != 8]  # part 8 is on order, but no line needs it
    sim.pending = {p: [rng.randint(0, 60), f"S{p % 3}"] for p in range(9) if p != 3}
    receipts = [(rng.choice([4, 4, rng.randint(0, 8)]), seq, rng.choice([None, 0, -1, 1, 1, 2, 2, 3, 4, 5, 6, 8, 40]))
                for seq in range(150)]
    if seed % 2:
        receipts = [(p, s, a) for p, s, a in receipts if a is not None and a > 0]
    return sim, receipts


def frames(spark, sim):
    lines = spark.createDataFrame([tuple(vars(x).values()) for x in sim.lines], LINES)
    pending = spark.createDataFrame([(p, q, s) for p, (q, s) in sim.pending.items()],
                                    "part_code bigint, quantity bigint, supplier string")
    return lines, pending


def line_set(sim):
    return sorted((x.order_id, x.part_code, x.line_no, x.available) for x in sim.lines)


def got_lines(df):
    return sorted(tuple(r) for r in df.select("order_id", "part_code", "line_no", "available").collect())


@pytest.mark.parametrize("seed,page", [*[(seed, stock.PAGE) for seed in range(5)], (0, 25), (1, 25)])
def test_receipts_in_sequence(spark, seed, page):
    sim, receipts = random_case(seed)
    lines, pending = frames(spark, sim)
    arrivals = spark.createDataFrame(receipts, "part_code bigint, seq bigint, arrived bigint")
    new_lines, new_pending, decisions = stock.allocate_receipts(lines, pending, arrivals, page)
    before = {p: q for p, (q, _) in sim.pending.items()}
    for part, _, arrived in receipts:
        sim.receive(part, arrived)
    assert got_lines(new_lines) == line_set(sim)
    assert {r.part_code: r.quantity for r in new_pending.collect()} == {p: q for p, (q, _) in sim.pending.items()}
    decided = decisions.collect()
    assert len(decided) == len(receipts)
    for part, quantity in before.items():
        own = [r for r in decided if r.part_code == part and r.outcome.startswith("applied")]
        if all(r.arrived is not None for r in own) and not any(
                r.outcome == "stock corrected" for r in decided if r.part_code == part):
            assert quantity - sum(r.arrived for r in own) == sim.pending[part][0]


def test_receipts_with_hot_parts(hot_spark):
    sim, receipts = random_case(1)
    lines, pending = frames(hot_spark, sim)
    arrivals = hot_spark.createDataFrame(receipts, "part_code bigint, seq bigint, arrived bigint")
    new_lines, _, _ = stock.allocate_receipts(lines, pending, arrivals, 40)
    for part, _, arrived in receipts:
        sim.receive(part, arrived)
    assert got_lines(new_lines) == line_set(sim)


@pytest.mark.parametrize("seed", range(4))
def test_one_arrival_per_part(spark, seed):
    sim, _ = random_case(seed)
    lines, _ = frames(spark, sim)
    rng = random.Random(seed)
    arrived = {p: rng.randint(1, 9) for p in range(9)}
    sim.pending = {p: [1000, "S"] for p in range(9)}
    got = stock.allocate_fifo(lines, spark.createDataFrame(list(arrived.items()), "part_code bigint, arrived bigint"))
    for part, quantity in arrived.items():
        sim.receive(part, quantity)
    assert got_lines(got) == line_set(sim)


def signed_lines(spark, needed: list[int], available: list[int] | None = None):
    rows = [(n, 1, 1, q, a, datetime.date(2024, 1, 1) + datetime.timedelta(n))
            for n, (q, a) in enumerate(zip(needed, available or [0] * len(needed)))]
    return spark.createDataFrame(
        rows, "order_id bigint, part_code bigint, line_no int, needed bigint, available bigint, requested date")


@pytest.mark.parametrize("needed, arrived, filled", [
    ([5, -2, 9], 3, 2), ([5, -2, 9], 5, 1), ([3, 0, 0, 4], 3, 3), ([2, -2, 2, 1], 2, 3), ([4, 4], 5, 0)])
def test_lines_are_marked_by_rank(spark, needed, arrived, filled):
    """The longest run of oldest lines that sums to the arrival, also with negative and zero quantities."""
    receipts = spark.createDataFrame([(1, arrived)], "part_code bigint, arrived bigint")
    got = {r.order_id: r.available for r in stock.allocate_fifo(signed_lines(spark, needed), receipts).collect()}
    assert got == {n: q if n < filled else 0 for n, q in enumerate(needed)}


def test_several_arrivals_of_a_part_are_refused(spark):
    receipts = spark.createDataFrame([(1, 2), (1, 3)], "part_code bigint, arrived bigint")
    with pytest.raises(Exception, match="several arrivals"):
        stock.allocate_fifo(signed_lines(spark, [2, 3]), receipts).collect()


def test_several_recent_arrivals_of_a_part(spark):
    lines = signed_lines(spark, [3, 2], [3, 2])  # the newest got 2
    asked = spark.createDataFrame([(1, 2), (1, 5), (1, 4), (2, 1), (1, 5)], "part_code bigint, arrived bigint")
    sizes = sorted(tuple(r) for r in stock.recent_prefix_size(lines, asked).collect())
    assert sizes == [(1, 2, 1), (1, 4, 0), (1, 5, 2), (1, 5, 2), (2, 1, 0)]
    got = sorted(tuple(r) for r in stock.recent_assignments(lines, asked).collect())
    assert got == [(1, 2, 1, 2, 1), (1, 5, 0, 3, 2), (1, 5, 1, 2, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_recent_assignments(spark, seed):
    sim, _ = random_case(seed)
    lines, _ = frames(spark, sim)
    rng = random.Random(seed)
    asked = {(p, rng.randint(1, 12)) for p in range(9) for _ in range(3)}
    arrivals = spark.createDataFrame(sorted(asked), "part_code bigint, arrived bigint")
    sizes = {(r.part_code, r.arrived): r.k for r in stock.recent_prefix_size(lines, arrivals).collect()}
    assert sizes == {(p, a): len(sim.recent(p, a)) for p, a in asked}
    got = sorted((r.part_code, r.arrived, r["rank"], r.order_id, r.quantity)
                 for r in stock.recent_assignments(lines, arrivals).collect())
    assert got == sorted((p, a, i + 1, x.order_id, x.available)
                         for p, a in asked for i, x in enumerate(sim.recent(p, a)))


def ranked_lines(spark, n):
    """``n`` supplied lines of part 1, the newest being order 1, each supplied 1."""
    columns = ["id AS order_id", "1L AS part_code", "1 AS line_no", "1L AS needed", "1L AS available", "0L AS price",
               "date_sub(DATE'2024-03-01', cast(id AS int)) AS requested"]
    return spark.range(1, n + 1).selectExpr(*columns)


@pytest.mark.parametrize("width, block", [(1, 1), (4, 3), (16, 1000), (4096, 1024)])
def test_recent_assignments_in_bins(spark, width, block):
    """Many arrivals of one part, at and beside the edges of the bins; ranks beyond the lines and 0 have no lines."""
    arrivals = spark.createDataFrame([(1, a) for a in [*range(-1, 40), 63, 64, 65, 100, 101]],
                                     "part_code bigint, arrived bigint")
    got = stock.recent_assignments(ranked_lines(spark, 100), arrivals, width, block).collect()
    want = [(a, n) for a in [*range(1, 40), 63, 64, 65, 100] for n in range(1, a + 1)]
    assert sorted((r.arrived, r.order_id) for r in got) == want
    assert all(r["rank"] == r.order_id and r.quantity == 1 for r in got)


@pytest.mark.parametrize("width, block", [(8, 5), (4096, 1024)])
def test_arrivals_meet_few_lines_in_vain(spark, width, block):
    newest = spark.range(1, 301).selectExpr("1L AS part_code", "id AS rank")
    sizes = spark.range(1, 301).selectExpr("1L AS part_code", "id AS arrived", "id AS k")
    met = stock._within_reach(newest, sizes, width, block)
    assert 300 * 301 // 2 <= met.count() < 300 * 301
    per_task = met.groupBy("_bin", "_block").agg({"rank": "max", "arrived": "count"})
    assert met.select("_bin", "rank").distinct().groupBy("_bin").count().agg({"count": "max"}).first()[0] <= width
    assert per_task.count() > 8


def test_reordering_in_sequence(spark):
    sim, _ = random_case(3)
    lines, pending = frames(spark, sim)
    catalog = spark.createDataFrame([(p, v, f"S{p % 3}" if v == 1 else "other") for p in range(7) for v in (2, 1)],
                                    "part_code bigint, version int, supplier string")
    sim.suppliers = {p: f"S{p % 3}" for p in range(7)}  # part 7 has no catalogue row
    approvals = [(order,) for order in (1, 5, 5, 30, 31, 32, 60, 61)]  # order 5 is approved twice
    given = spark.createDataFrame(approvals, "order_id bigint")
    sim.decisions = {order: "Negativo" for order in range(90)}
    old = set(sim.pending)
    existing = stock.reorder_existing(pending, lines, given, catalog)
    new = stock.reorder_new(pending, lines, given, catalog)
    for (order,) in approvals:
        sim.decide(order, "Positivo")
    want = {p: tuple(q) for p, q in sim.pending.items()}
    rows = stock.pending_stock(pending, lines, given, catalog).collect()
    assert {r.part_code: (r.quantity, r.supplier) for r in rows} == want
    assert {r.part_code: r.quantity for r in existing.collect()} == {p: want[p][0] for p in old}
    assert {r.part_code: r.quantity for r in new.collect()} == {p: q[0] for p, q in want.items() if p not in old}
    once = stock.pending_stock(pending, lines, given, catalog, dedupe=True)
    assert once.agg({"quantity": "sum"}).first()[0] < sum(q for q, _ in want.values())


def test_supplier_is_that_of_the_lowest_version(spark):
    catalog = spark.createDataFrame([("7", 2, "late"), ("7", 1, "first"), ("9", 3, None)],
                                    "part_code string, version int, supplier string")
    assert {tuple(r) for r in stock.supplier_of_part(catalog).collect()} == {("7", "first"), ("9", None)}
