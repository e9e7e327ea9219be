"""Loads that count rejects and broken rules while they write, against a second look at the same rows."""

from __future__ import annotations

from tests.test_bucketed import lose_commit, rows_of
from tests.test_streams import folder, write_event_files  # noqa: F401
from wrenchline.operators import integrity
from wrenchline.schemas import SCHEMAS, Rule
from wrenchline.sources import audited, tables

RULES = [Rule("not_null", "lines", ("available",)), Rule("enum", "lines", ("name",), values=("Disco", "Filtro")),
         Rule("length", "lines", ("part_code",), limit=2), Rule("range", "lines", ("price",), type_name="smallint")]
RAW = "a string, b string, c string, d string, e string, f string, g string"
ROWS = [("1", "168", "Disco ", "2", "0", "40", "2017-05-25"), ("2", "9", "Filtro", "2.5", None, "40000", "2017-05-25"),
        ("3", "9", "Filtro", "99999", "0", "40", "2017-05-25"), ("4", "9", "Vite", "1", "0", "40", "2017-05-26"),
        ("x", "9", None, "1", "0", "40", "2017-05-25"), ("5", "1234", "Vite", "1", None, None, "2017-05-25")]
SCHEMA = SCHEMAS["lines"]


def counted(report):
    return {r.rule: r.violations for r in report.collect()}


def expected(spark, rows):
    good, bad = tables.ingest_rows(spark.createDataFrame(rows, RAW), SCHEMA, positional=True)
    report = integrity.constraint_report({"lines": good}, RULES)
    return {"rows": len(rows), "rejected": bad.count(), **counted(report)}, good, bad


def test_counts_come_with_the_write(spark, folder):
    raw = spark.createDataFrame(ROWS, RAW)
    reads = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    report = audited.load_audited(raw.mapInArrow(watched, RAW), SCHEMA, f"{folder}/t", RULES, positional=True)
    want, good, bad = expected(spark, ROWS)
    assert counted(report) == want and reads.value == len(ROWS)
    assert want["rejected"] == 2 and min(want.values()) >= 1
    assert rows_of(audited.accepted(spark, f"{folder}/t", SCHEMA)) == rows_of(good)
    stored = audited.rejects(spark, f"{folder}/t", SCHEMA)
    assert sorted(r.problem for r in stored.collect()) == sorted(r.problem for r in bad.collect())
    assert stored.selectExpr("get_json_object(raw, '$.order_id') AS o").orderBy("o").first().o == "3"


def test_a_new_load_replaces_the_old_and_may_be_empty(spark, folder):
    path = f"{folder}/t"
    audited.load_audited(spark.createDataFrame(ROWS, RAW), SCHEMA, path, RULES, positional=True)
    report = audited.load_audited(spark.createDataFrame([], RAW), SCHEMA, path, RULES, positional=True)
    assert set(counted(report).values()) == {0} and len(counted(report)) == 6
    assert audited.accepted(spark, path, SCHEMA).count() == audited.rejects(spark, path, SCHEMA).count() == 0
    report = audited.load_audited(spark.createDataFrame(ROWS[:1], RAW), SCHEMA, path, positional=True)
    assert counted(report) == {"rows": 1, "rejected": 0}


def test_stream_counts_each_row_once(spark, folder):
    want, good, bad = expected(spark, ROWS)
    stream = write_event_files(spark.createDataFrame(ROWS, RAW), f"{folder}/in", "a")
    for again in (False, True):
        if again:
            lose_commit(folder, 2)
        audited.stream_audited(stream, SCHEMA, f"{folder}/out", f"{folder}/cp", RULES, positional=True).awaitTermination()
        assert counted(audited.stream_counts(spark, f"{folder}/out")) == want
        assert rows_of(audited.accepted(spark, f"{folder}/out/rows", SCHEMA)) == rows_of(good)
        assert audited.rejects(spark, f"{folder}/out/rows", SCHEMA).count() == bad.count()
