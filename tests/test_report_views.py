"""Reports kept from signed changes against the batch reports of the tables after them."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tests.test_bucketed import lose_commit
from tests.test_streams import folder  # noqa: F401
from wrenchline.operators import reports
from wrenchline.sources.manifests import numbers, read_manifest
from wrenchline.streaming.report_views import CATALOG, ReportViews, revenue_report, stream_report_views, usage_report

SCHEMA = "part_code string, version int, name string, category string, brand string, price int, supplier string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def catalog_row(rng):
    """Versions are unique per part, as the key asks; a name may have several parts and categories."""
    part = rng.randrange(14)
    return (str(part), 1, rng.choice(["n1", "n2", "n3", "n4", f"p{part}"]), rng.choice(["a", "b", None]),
            f"brand {rng.randrange(9)}", rng.randrange(1, 90), rng.choice(["s1", "s2", "s3", None]))


def line_row(rng):
    part = rng.randrange(16)
    return (str(part), None, rng.choice(["n1", "n2", "n3", f"p{part}"]), None, None, None, None)


def write_changes(spark, folder, number, changes):
    spark.createDataFrame([(k, w, *row) for k, w, row in changes], f"changed string, weight int, {SCHEMA}") \
        .coalesce(1).write.mode("append").parquet(f"{folder}/changes/n={number}")


def test_reports_after_inserts_updates_and_deletes(spark, folder):
    rng = random.Random(5)
    catalog = {}
    while len(catalog) < 9:
        row = catalog_row(rng)
        catalog[row[0]] = row
    lines = Counter(line_row(rng) for _ in range(25))
    first = (frame(spark, list(lines.elements())).select("part_code", "name"), frame(spark, list(catalog.values())))
    views = f"{folder}/views"

    def run():
        changes = spark.readStream.schema(f"changed string, weight int, {SCHEMA}").parquet(f"{folder}/changes/n=*")
        stream_report_views(changes, *first, views, f"{folder}/cp", buckets=2).awaitTermination()

    def check():
        now = frame(spark, list(lines.elements())).select("part_code", "name")
        want = reports.supplier_revenue(now, frame(spark, list(catalog.values()))).collect()
        assert list(map(tuple, revenue_report(spark, views, 2).collect())) == list(map(tuple, want))
        want = reports.category_usage(frame(spark, list(catalog.values())), now).collect()
        assert list(map(tuple, usage_report(spark, views, 2).collect())) == list(map(tuple, want))

    for step in range(3):
        changes = []
        for _ in range(rng.randrange(1, 5)):  # lines come and go
            row = line_row(rng)
            lines[row] += 1
            changes.append(("lines", 1, row))
        for row in rng.sample(sorted(lines, key=str), 3):
            gone = lines.pop(row)
            changes.append(("lines", -gone, row))
        new = catalog_row(rng)
        for part in {new[0], rng.choice(sorted(catalog))}:
            if part in catalog:
                changes.append(("catalog", -1, catalog.pop(part)))
        catalog[new[0]] = new
        changes.append(("catalog", 1, new))
        if step == 1:  # the first part of every supplier goes
            for part in sorted(catalog, key=int)[:4]:
                changes.append(("catalog", -1, catalog.pop(part)))
        if step == 1:  # a line without name
            row = ("3", None, None, None, None, None, None)
            lines[row] += 1
            changes.append(("lines", 1, row))
        if step == 2:
            row = ("3", None, None, None, None, None, None)
            if lines[row]:
                changes.append(("lines", -lines.pop(row), row))
        lines = +lines
        write_changes(spark, folder, step, changes)
        run()
        check()
        if step == 1:  # the micro-batch comes again
            lose_commit(folder, step)
            run()
            check()
    assert max(numbers(spark, f"{views}/revenue")) == 3


def test_a_small_change_opens_few_buckets_and_a_row_may_go_before_it_comes(spark, folder):
    rows = [(str(k), 1, f"p{k}", "a", "b", 10, f"s{k}") for k in range(40)]
    lines = [(str(k), None, f"p{k}", None, None, None, None) for k in range(40)]
    first = (frame(spark, lines).select("part_code", "name"), frame(spark, rows))
    views = f"{folder}/views"

    def run(number, changes):
        write_changes(spark, folder, number, changes)
        stream = spark.readStream.schema(f"changed string, weight int, {SCHEMA}").parquet(f"{folder}/changes/n=*")
        stream_report_views(stream, *first, views, f"{folder}/cp", buckets=32).awaitTermination()
        return {r.supplier: (int(r.revenue), r.lines_sold) for r in revenue_report(spark, views, 32).collect()}

    early = ("99", 1, "p99", "c", "z", 7, "s3")
    got = run(0, [("catalog", -1, early), ("lines", 1, ("99", None, "p99", None, None, None, None)),
                  ("lines", -1, lines[5]), ("lines", 0, lines[6])])
    assert "s5" not in got and got["s3"] == (10, 1) and len(got) == 39
    buckets = {table: read_manifest(spark, f"{views}/{table}")[1]["buckets"].values() for table in ("sold", "entries", "revenue")}
    written = {table: sum(b["v"] == 1 for b in own) for table, own in buckets.items()}
    assert written["sold"] <= 3 and written["entries"] == 1 and written["revenue"] <= 1
    assert run(1, [("catalog", 2, early)])["s3"] == (17, 2)
    usage = {r.category: (r.used, r.unused, r.total) for r in usage_report(spark, views, 32).collect()}
    assert usage == {"a": (39, 1, 40), "c": (1, None, 1)}
    assert CATALOG == frame(spark, rows).columns


def test_changes_that_cancel_out_open_no_bucket_and_equal_ones_count_once(spark, folder):
    rows = [(str(k), 1, f"p{k}", "a", "b", 10, "s1") for k in range(4)]
    lines = [(str(k), None, f"p{k}", None, None, None, None) for k in range(4)]
    first = (frame(spark, [*lines, lines[0], lines[0]]).select("part_code", "name"), frame(spark, rows))
    views = f"{folder}/views"

    def run(number, changes):
        write_changes(spark, folder, number, changes)
        stream = spark.readStream.schema(f"changed string, weight int, {SCHEMA}").parquet(f"{folder}/changes/n=*")
        stream_report_views(stream, *first, views, f"{folder}/cp", buckets=2).awaitTermination()
        return [(int(r.revenue), r.lines_sold) for r in revenue_report(spark, views, 2).collect()]

    assert run(0, [("lines", 1, lines[1]), ("lines", -1, lines[1]), ("catalog", 2, rows[2]), ("catalog", -2, rows[2])]) == [(60, 6)]
    assert max(numbers(spark, f"{views}/sold")) == max(numbers(spark, f"{views}/entries")) == 0
    assert run(1, [("lines", 1, lines[1])] * 3 + [("lines", -1, lines[1]), ("lines", -2, lines[0])]) == [(60, 6)]
    assert {r.part_code: r.n for r in ReportViews(spark, views, 2).sold.read().collect()} == {"0": 1, "1": 3, "2": 1, "3": 1}
