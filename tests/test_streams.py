"""Streams over several micro-batches against their batch twins, with restarts and repeated batches."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_stock import frames, got_lines, line_set, random_case
from wrenchline.operators import gates, orders, stock
from wrenchline.sources import versions
from wrenchline.streaming import streams

TODAY = datetime.date(2024, 5, 2)


@pytest.fixture()
def folder(tmp_path):
    return f"file:{tmp_path}"


def write_event_files(df, folder, order, files=3):
    """Several files in event order, so that each micro-batch of one file continues the one before."""
    total = df.count()
    ranked = df.orderBy(order).collect()
    for number in range(files):
        part = ranked[number * total // files:(number + 1) * total // files]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return streams.event_source(df.sparkSession, folder, df.schema, max_files=1)


def test_receipts_over_batches(spark, folder):
    sim, receipts = random_case(1)
    lines, pending = frames(spark, sim)
    arrivals = spark.createDataFrame(receipts, "part_code bigint, seq bigint, arrived bigint")
    stream = write_event_files(arrivals, f"{folder}/in", "seq")
    streams.stream_receipts(stream, lines, pending, f"{folder}/out", f"{folder}/cp").awaitTermination()
    decided = spark.read.parquet(f"{folder}/out/decisions")
    assert decided.select("batch").distinct().count() == 3
    for part, _, arrived in receipts:
        sim.receive(part, arrived)
    assert got_lines(stock.supplied_lines(lines, decided.drop("batch"))) == line_set(sim)
    state = versions.read_version(spark, f"{folder}/out/state")
    assert {r.part_code: r.quantity for r in state.collect()} == {p: q for p, (q, _) in sim.pending.items()}


def test_decisions_over_batches_and_a_repeated_batch(spark, folder):
    sim, _ = random_case(2)
    lines, pending = frames(spark, sim)
    catalog = spark.createDataFrame([(p, 1, f"S{p % 3}") for p in range(9)],
                                    "part_code bigint, version int, supplier string")
    events = spark.createDataFrame(
        [(o, "Positivo" if o % 3 else "Negativo", s) for s, o in enumerate([3, 4, 5, 5, 7, 8, 20, 21, 22, 4])],
        "order_id bigint, outcome string, seq bigint")
    stream = write_event_files(events, f"{folder}/in", "seq")
    out = f"{folder}/out"
    streams.stream_decisions(stream, lines, catalog, pending, out, f"{folder}/cp").awaitTermination()
    want = stock.pending_stock(pending, lines, orders.approvals_of(events), catalog)
    got = versions.read_version(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # The commit of the last micro-batch is lost: it comes again and must not count twice.
    for name in ("2", ".2.crc"):
        os.remove(f"{folder}/cp/commits/{name}".removeprefix("file:"))
    streams.stream_decisions(stream, lines, catalog, pending, out, f"{folder}/cp").awaitTermination()
    assert sorted(map(tuple, versions.read_version(spark, out).collect())) == sorted(map(tuple, want.collect()))
    # Another checkpoint on the same path would count everything twice: refused.
    with pytest.raises(StreamingQueryException, match="belongs to another checkpoint"):
        streams.stream_decisions(stream, lines, catalog, pending, out, f"{folder}/new").awaitTermination()


def test_a_second_checkpoint_is_refused_before_it_writes(spark, folder):
    """Also when the path is at exactly the version that the other checkpoint would write next."""
    sim, _ = random_case(2)
    lines, pending = frames(spark, sim)
    catalog = spark.createDataFrame([(p, 1, f"S{p % 3}") for p in range(9)],
                                    "part_code bigint, version int, supplier string")
    for name, rows in (("a", [(1, "Positivo", 1)]), ("b", [(1, "Positivo", 2)])):
        spark.createDataFrame(rows, "order_id bigint, outcome string, seq bigint").coalesce(1).write.parquet(f"{folder}/{name}")
    schema = spark.read.parquet(f"{folder}/a").schema
    out = f"{folder}/out"
    first = streams.event_source(spark, f"{folder}/a", schema)
    streams.stream_decisions(first, lines, catalog, pending, out, f"{folder}/cp-a").awaitTermination()
    before = sorted(map(tuple, versions.read_version(spark, out).collect()))
    second = streams.event_source(spark, f"{folder}/b", schema)
    with pytest.raises(StreamingQueryException, match="belongs to another checkpoint"):
        streams.stream_decisions(second, lines, catalog, pending, out, f"{folder}/cp-b").awaitTermination()
    assert sorted(map(tuple, versions.read_version(spark, out).collect())) == before


def test_quotes_refuse_a_second_checkpoint(spark, folder):
    for name, order in (("a", 1), ("b", 2)):
        spark.createDataFrame([(order, 1, 5)], "order_id int, needed int, price int").write.parquet(f"{folder}/{name}")
    schema = spark.read.parquet(f"{folder}/a").schema
    stream = streams.event_source(spark, f"{folder}/a", schema)
    streams.stream_quote(stream, f"{folder}/out", f"{folder}/cp-a").awaitTermination()
    with pytest.raises(StreamingQueryException, match="belongs to another checkpoint"):
        streams.stream_quote(streams.event_source(spark, f"{folder}/b", schema), f"{folder}/out",
                             f"{folder}/cp-b").awaitTermination()
    assert [r.order_id for r in streams.current_quotes(spark, f"{folder}/out").collect()] == [1]


def test_quotes_over_batches(spark, folder):
    lines = spark.createDataFrame([(n % 4, n % 3 + 1, 10 + n, n) for n in range(30)],
                                  "order_id int, needed int, price int, seq int")
    stream = write_event_files(lines, f"{folder}/in", "seq")
    streams.stream_quote(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    heads = lines.select("order_id").distinct()
    want = {r.order_id: r.quote for r in orders.order_quote(heads, lines).collect()}
    assert {r.order_id: r.quote for r in streams.current_quotes(spark, f"{folder}/out").collect()} == want


def test_stateless_streams(spark, folder):
    catalog = spark.createDataFrame([("1", "F", "M", "T")], "part_code string, brand string, model string, trim string")
    vehicles = spark.createDataFrame([("P1", "F", "M", "T", 1), ("P2", "G", "M", "T", 2)],
                                     "plate string, brand string, model string, trim string, seq int")
    stream = write_event_files(vehicles, f"{folder}/v", "seq", 2)
    streams.write_files(streams.stream_gate(stream, catalog), f"{folder}/gate", f"{folder}/cp1").awaitTermination()
    got = {r.plate: r.reason for r in spark.read.parquet(f"{folder}/gate").collect()}
    assert got == {r.plate: r.reason for r in gates.marked_vehicles(vehicles, catalog).collect()}

    labor = spark.createDataFrame([(1, 1, 4), (2, 2, 0), (3, 3, 1)], "order_id int, seq int, labor int")
    quotes = spark.createDataFrame([(1, 255), (2, 9)], "order_id int, quote int")
    stream = write_event_files(labor, f"{folder}/l", "seq", 2)
    closed = streams.stream_final_cost(stream, quotes, TODAY)
    streams.write_files(closed, f"{folder}/cost", f"{folder}/cp2").awaitTermination()
    assert [(r.order_id, r.final_cost, r.end_date) for r in spark.read.parquet(f"{folder}/cost").collect()] == [
        (1, 381, TODAY)]

    opened = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (1, 4)], "order_id int, seq int")
    stream = write_event_files(opened, f"{folder}/o", "seq", 2)
    streams.write_files(streams.stream_default_decision(stream), f"{folder}/dec", f"{folder}/cp3").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/dec").collect()) == [
        (1, "Negativo"), (2, "Negativo")]


def test_vehicles_clear_finished_stock(spark, folder):
    pending = spark.createDataFrame([(1, 0, "S"), (2, 5, "S")], "part_code int, quantity int, supplier string")
    vehicles = spark.createDataFrame([("P1", 1), ("P2", 2)], "plate string, seq int")
    stream = write_event_files(vehicles, f"{folder}/v", "seq", 2)
    streams.stream_purge(stream.filter(F.col("seq") > 99), pending, f"{folder}/a", f"{folder}/cp1").awaitTermination()
    assert versions.read_version(spark, f"{folder}/a").count() == 2
    streams.stream_purge(stream, pending, f"{folder}/b", f"{folder}/cp2").awaitTermination()
    assert [r.part_code for r in versions.read_version(spark, f"{folder}/b").collect()] == [2]


def test_default_decisions_spare_stored_ones(spark, folder):
    spark.createDataFrame([(1,), (2,), (2,), (3,)], "order_id bigint").write.parquet(f"{folder}/in")
    stream = streams.event_source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    stored = spark.createDataFrame([(3, "Positivo"), (3, "Negativo")], "order_id bigint, outcome string")
    made = streams.stream_default_decision(stream, stored)
    streams.write_files(made, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert sorted(r.order_id for r in spark.read.parquet(f"{folder}/out").collect()) == [1, 2]
