"""Bucketed tables, levelled logs and engine-held state: small changes, lost commits, half-written versions."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_stock import frames, random_case
from tests.test_streams import folder, write_event_files  # noqa: F401
from wrenchline.operators import orders, stock
from wrenchline.sources import runs
from wrenchline.sources.buckets import Buckets
from wrenchline.streaming import bucketed, receipt_state, streams


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def lose_commit(folder, batch):
    for name in (f"{batch}", f".{batch}.crc"):
        os.remove(f"{folder}/cp/commits/{name}".removeprefix("file:"))


def test_an_update_writes_the_touched_buckets_only(spark, folder):
    base = spark.range(1000).selectExpr("id AS part_code", "id % 7 AS quantity")
    table = Buckets(spark, f"{folder}/t", ("part_code",), 16, "quantity")
    table.create(base)
    table.create(base.filter("false"))
    assert rows_of(table.read()) == rows_of(base)
    changes = spark.createDataFrame([(3, 50), (4, 60), (2000, 70)], "part_code bigint, quantity bigint")
    touched = table.touched(changes)

    def change(rows):
        return rows.join(changes.select("part_code"), "part_code", "left_anti").unionByName(changes)

    assert table.update(1, touched, change) == len(touched) <= 3
    assert rows_of(table.read()) == rows_of(change(base))
    assert {f.split("/bucket=")[1].split("/")[0] for f in table.read().inputFiles() if "/v=1/" in f} == set(map(str, touched))
    assert {b for b in touched} == {int(f.split("/bucket=")[1].split("/")[0]) for f in table.read(touched).inputFiles()}
    # Again: nothing. A version that was begun and not committed: written anew.
    assert table.update(1, touched, change) == 0
    base.withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{folder}/t/data/v=2")
    assert rows_of(table.read()) == rows_of(change(base))
    assert table.update(2, {1, 2}, lambda rows: rows.filter("quantity <> 0")) == 2
    assert table.read({1, 2}).filter("quantity = 0").count() == 0
    assert table.within_zone(0) == set(range(16)) - {1, 2}
    # A bucket that becomes empty is no longer there; readers of older versions keep theirs.
    older = table.read()
    assert table.update(3, {5}, lambda rows: rows.filter("false")) == 0
    assert table.read({5}).count() == 0 and older.count() > table.read().count()
    with pytest.raises(ValueError, match="left the buckets"):
        table.update(4, {6}, lambda rows: base)
    with pytest.raises(ValueError, match="another checkpoint"):
        table.is_written(1)
    assert not table.is_written(4)


def test_old_versions_and_buckets_go(spark, folder):
    table = Buckets(spark, f"{folder}/t", ("k",), 4)
    table.create(spark.range(40).selectExpr("id AS k", "0 AS n"))
    for version in range(1, 8):
        table.update(version, {version % 4}, lambda rows: rows.withColumn("n", F.col("n") + 1))
    at = f"{folder}/t/data".removeprefix("file:")
    assert sorted(os.listdir(at)) == ["v=3", "v=4", "v=5", "v=6", "v=7"] or len(os.listdir(at)) <= 6
    assert table.read().count() == 40 and table.read().agg(F.sum("n") > 40).first()[0]


def test_decisions_rewrite_touched_buckets_and_survive_a_lost_commit(spark, folder):
    sim, _ = random_case(2)
    lines, pending = frames(spark, sim)
    catalog = spark.createDataFrame([(p, 1, f"S{p % 3}") for p in range(9)],
                                    "part_code bigint, version int, supplier string")
    events = spark.createDataFrame(
        [(o, "Positivo" if o % 3 else "Negativo", s) for s, o in enumerate([3, 4, 5, 5, 7, 8, 20, 21, 22, 4])],
        "order_id bigint, outcome string, seq bigint")
    stream = write_event_files(events, f"{folder}/in", "seq")
    out, want = f"{folder}/out", stock.pending_stock(pending, lines, orders.approvals_of(events), catalog)
    for again in (False, True):
        if again:
            lose_commit(folder, 2)
        bucketed.stream_decisions_bucketed(stream, lines, catalog, pending, out, f"{folder}/cp", 8).awaitTermination()
        assert rows_of(bucketed.stock_table(spark, f"{out}/stock", 8).read()) == rows_of(want)
    with pytest.raises(StreamingQueryException, match="belongs to another checkpoint"):
        bucketed.stream_decisions_bucketed(stream, lines, catalog, pending, out, f"{folder}/new", 8).awaitTermination()


def test_purge_leaves_buckets_without_finished_rows(spark, folder):
    pending = spark.range(400).selectExpr("id AS part_code", "IF(id IN (3, 77), 0, id + 1) AS quantity", "id % 3 AS supplier")
    stream = write_event_files(spark.range(9).selectExpr("id AS plate"), f"{folder}/in", "plate")
    bucketed.stream_purge_bucketed(stream, pending, f"{folder}/out", f"{folder}/cp", 32).awaitTermination()
    table = bucketed.stock_table(spark, f"{folder}/out", 32)
    assert rows_of(table.read()) == rows_of(pending.filter("quantity <> 0"))
    files = table.read().inputFiles()
    assert 1 <= len([f for f in files if "/v=0/" not in f]) <= 2 and table.within_zone(0) == set()


def test_runs_stay_few_and_the_newest_row_wins(spark, folder):
    path, want = f"{folder}/log", {}
    for batch in range(42):
        rows = [(k, batch * 100 + k) for k in range(batch % 5, 20, 5)]
        want |= dict(rows)
        runs.append_run(spark.createDataFrame(rows, "k int, v int").coalesce(1), path, batch, ["k"])
        if batch == 20:
            held = runs.read_runs(spark, path, ["k"])
            seen = rows_of(held)
            runs.append_run(spark.createDataFrame([(1, -1)], "k int, v int"), path, batch, ["k"])  # a repeated batch
        if batch == 22:
            assert rows_of(held) == seen
    assert dict(rows_of(runs.read_runs(spark, path, ["k"]))) == want
    names = runs.run_names(spark, path)
    assert len(names) <= 9 and max(int(n.split("-")[0]) for n in names) == 2
    with pytest.raises(ValueError, match="another checkpoint"):
        runs.append_run(spark.createDataFrame([(1, 1)], "k int, v int"), path, 3, ["k"])


def test_compacted_quotes_over_batches(spark, folder):
    lines = spark.createDataFrame([(n % 4, n % 3 + 1, 10 + n, n) for n in range(30)],
                                  "order_id int, needed int, price int, seq int")
    stream = write_event_files(lines, f"{folder}/in", "seq", files=6)
    want = orders.order_quote(lines.select("order_id").distinct(), lines)
    for again in (False, True):
        if again:
            lose_commit(folder, 5)
        bucketed.stream_quote_compacted(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
        assert rows_of(bucketed.compacted_quotes(spark, f"{folder}/out").selectExpr("order_id", "CAST(quote AS DOUBLE)")) == \
            rows_of(want.selectExpr("order_id", "CAST(quote AS DOUBLE)"))
    assert len(runs.run_names(spark, f"{folder}/out")) <= 3


def test_default_decisions_with_bounded_state(spark, folder):
    day = datetime.datetime(2024, 5, 1)
    # Order 1 is opened again long after the watermark has passed; 2 has a decision; 3 gets one while the stream runs.
    opened = spark.createDataFrame(
        [(n, order, day + datetime.timedelta(hours=hours)) for n, (order, hours) in enumerate(
            [(1, 0), (1, 0), (2, 1), (4, 30), (5, 31), (6, 32), (1, 60), (3, 61), (7, 90)])],
        "n int, order_id bigint, at timestamp")
    decided = spark.createDataFrame([(2, "Positivo")], "order_id bigint, outcome string")
    out = f"{folder}/out"
    stream = write_event_files(opened.filter("n < 6"), f"{folder}/in", "n", files=2).drop("n")
    query = bucketed.stream_default_decision_bounded(stream, decided, out, f"{folder}/cp", "at", "2 hours", 8)
    query.awaitTermination()
    table = bucketed.decisions_table(spark, out, 8)
    first = [(1, "Negativo"), (2, "Positivo"), (4, "Negativo"), (5, "Negativo"), (6, "Negativo")]
    assert rows_of(table.read()) == first
    lose_commit(folder, max(p["batchId"] for p in query.recentProgress))
    query = bucketed.stream_default_decision_bounded(stream, decided, out, f"{folder}/cp", "at", "2 hours", 8)
    query.awaitTermination()
    assert rows_of(table.read()) == first
    write_event_files(opened.filter("n >= 6"), f"{folder}/in", "n", files=3)
    query = bucketed.stream_default_decision_bounded(stream, decided, out, f"{folder}/cp", "at", "2 hours", 8)
    query.awaitTermination()
    assert rows_of(table.read()) == [(1, "Negativo"), (2, "Positivo"), *[(k, "Negativo") for k in (3, 4, 5, 6, 7)]]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(states) <= 4 and states[-1] <= 2


@pytest.mark.parametrize("seed", [1, 5])
def test_receipts_in_engine_state(spark, folder, seed):
    sim, receipts = random_case(seed)
    lines, pending = frames(spark, sim)
    known = max(s for _, s, _ in receipts)
    receipts = [*receipts, (receipts[0][0], known + 1, None), (receipts[1][0], known + 2, -3), (999, known + 3, 1)]
    arrivals = spark.createDataFrame(receipts, "part_code bigint, seq bigint, arrived bigint")
    stream = write_event_files(arrivals, f"{folder}/in", "seq")
    want = rows_of(stock.receipt_decisions(lines, pending, arrivals).drop("arrived"))
    for again in (False, True):
        if again:
            lose_commit(folder, 2)
        decided = receipt_state.receipts_in_state(stream, lines, pending)
        streams.write_files(decided, f"{folder}/out", f"{folder}/cp").awaitTermination()
        got = spark.read.parquet(f"{folder}/out")
        assert rows_of(got.drop("arrived")) == want
    assert got.filter("outcome = 'applied'").count() > 0


def test_pages_hold_every_total_once(spark):
    lines = spark.range(20_000).selectExpr(
        "id % 2 AS part_code", "id AS order_id", "1 AS line_no", "date'2024-01-01' AS requested",
        "id % 3 AS needed", "0 AS available")
    pending = spark.createDataFrame([(0, 5), (1, None)], "part_code bigint, quantity bigint")
    state = receipt_state.initial_pages(lines, pending).collect()
    pages = [r for r in state if r["page"] >= 0]
    assert {r["part_code"] for r in pages} == {0} and max(len(r["totals"]) for r in pages) <= receipt_state.PAGE_SPAN
    totals = [t for r in pages for t in r["totals"]]
    assert len(totals) == len(set(totals)) and all(t // receipt_state.PAGE_SPAN == r["page"] for r in pages for t in r["totals"])
    heads = {r["part_code"]: r for r in state if r["page"] < 0}
    assert heads[0]["total"] == sum(i % 3 for i in range(0, 20_000, 2)) and not heads[1]["on_order"]


@pytest.fixture()
def few_shelves(spark, monkeypatch):
    """Parts share buckets and shelves, most have pages, and a bucket's state and receipts come in several tables."""
    for name, value in {"BUCKETS": 2, "SHELVES": 3, "NEAR_LINES": 2, "PAGE_SPAN": 8}.items():
        monkeypatch.setattr(receipt_state, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed, kind", [(2, "bigint"), (3, "string")])
def test_parts_share_shelves(spark, folder, few_shelves, seed, kind):
    sim, receipts = random_case(seed)
    part = F.col("part_code").cast(kind)
    lines, pending = (df.withColumn("part_code", part) for df in frames(spark, sim))
    far = 2 ** 60
    receipts = [*[(p, far + s, a) for p, s, a in receipts], (999, far + 1000, 1), (998, None, 1)]
    arrivals = spark.createDataFrame(receipts, "part_code bigint, seq bigint, arrived bigint").withColumn("part_code", part)
    stream = write_event_files(arrivals, f"{folder}/in", "seq")
    want = stock.receipt_decisions(lines, pending, arrivals).collect()
    for again in (False, True):
        if again:
            lose_commit(folder, 2)
        decided = receipt_state.receipts_in_state(stream, lines, pending)
        streams.write_files(decided, f"{folder}/out", f"{folder}/cp").awaitTermination()
        got = spark.read.parquet(f"{folder}/out")
        assert got.schema["part_code"].dataType == arrivals.schema["part_code"].dataType
        assert sorted(map(str, got.drop("arrived").collect())) == sorted(str(r) for r in spark.createDataFrame(
            want, got.schema).drop("arrived").collect())
    assert got.filter("outcome = 'applied'").count() > 0


def test_state_has_a_row_per_shelf_not_per_part(spark, folder, few_shelves):
    lines = spark.range(400).selectExpr("id % 200 AS part_code", "id AS order_id", "1 AS line_no",
                                        "date'2024-01-01' AS requested", "3 AS needed", "0 AS available")
    pending = spark.range(200).selectExpr("id AS part_code", "6 AS quantity")
    arrivals = spark.range(200).selectExpr("id AS part_code", "id AS seq", "3 + id % 2 AS arrived")
    decided = receipt_state.receipts_in_state(write_event_files(arrivals, f"{folder}/in", "seq"), lines, pending)
    query = streams.write_files(decided, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]} == {6}
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").selectExpr("seq % 2", "outcome").collect()} == {
        (0, "applied"), (1, "refused: no exact match")}


@pytest.mark.parametrize("codes", ["id % 3", "CAST(id % 3 AS STRING)"])
def test_first_state_of_hot_parts(hot_spark, codes):
    lines = hot_spark.range(600).selectExpr(
        f"IF(id % 7 = 0, {codes}, CAST(100 + id AS {'STRING' if 'STRING' in codes else 'BIGINT'})) AS part_code", "id AS order_id",
        "1 AS line_no", "date'2024-01-01' AS requested", "id % 5 * 900 AS needed", "0 AS available")
    pending = lines.groupBy("part_code").agg(F.lit(9).alias("quantity"))
    hot = stock.hot_parts(lines)
    states = [receipt_state.initial_pages(lines, pending, h).collect() for h in (hot, [])]
    assert len(hot) == 3 and sorted(map(str, states[0])) == sorted(map(str, states[1]))
