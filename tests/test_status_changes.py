"""Status of orders from streams against the batch status of the tables after each round of events."""

from __future__ import annotations

import random

from tests.test_bucketed import lose_commit, rows_of
from tests.test_streams import folder  # noqa: F401
from wrenchline.operators import orders
from wrenchline.schemas import ACCEPTED, REFUSED
from wrenchline.streaming import status_changes

LINES = "order_id bigint, price int, needed int, available int, weight int"
SCHEMAS = {"opened": "order_id bigint", "lines": LINES, "decisions": "order_id bigint, outcome string, seq bigint",
           "labor": "order_id bigint, labor int, seq bigint"}


class Events:
    """Files of events in rounds, and the tables as they are after them."""

    def __init__(self, spark, folder, seed):
        self.spark, self.folder, self.random = spark, folder, random.Random(seed)
        self.opened, self.lines, self.decided, self.worked, self.seq = [], [], {}, {}, 0

    def round(self, number):
        rng = self.random
        new = [k for k in range(number * 10, number * 10 + 10) if rng.random() < 0.8]
        self.opened += new
        lines, decisions, labor = [], [], []
        for _ in range(12):
            line = (rng.randrange(number * 10 + 12), rng.choice([0, 10, None]), rng.choice([1, 2, None]), 0)
            self.lines.append(line)
            lines.append((*line, 1))
        for line in rng.sample(self.lines, 8):  # delivered, or taken back
            self.lines.remove(line)
            lines.append((*line, -1))
            if rng.random() < 0.8:
                self.lines.append((*line[:3], line[2]))
                lines.append((*line[:3], line[2], 1))
        for _ in range(8):
            self.seq += 1
            key = rng.randrange(number * 10 + 12)
            self.decided[key] = rng.choice([ACCEPTED, ACCEPTED, REFUSED, None])
            decisions.append((key, self.decided[key], self.seq))
            key = rng.randrange(number * 10 + 12)
            self.worked[key] = rng.choice([0, 3, None])
            labor.append((key, self.worked[key], self.seq))
        for name, rows in (("opened", [(k,) for k in new]), ("lines", lines), ("decisions", decisions), ("labor", labor)):
            self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(
                f"{self.folder}/{name}/n={number}")

    def start(self, out):
        streams = [self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}/n=*") for name, schema in SCHEMAS.items()]
        return status_changes.stream_order_status(*streams, out, f"{self.folder}/cp", buckets=3)

    def expected(self):
        frame = self.spark.createDataFrame
        jobs = frame([(k, self.worked.get(k, 0)) for k in self.opened], "order_id bigint, labor int")
        lines = frame(self.lines, "order_id bigint, price int, needed int, available int")
        decisions = frame([*self.decided.items()], "order_id bigint, outcome string")
        return rows_of(orders.priced_order_status(jobs, lines, decisions))


def test_status_follows_every_input(spark, folder):
    events, out = Events(spark, folder, 3), f"{folder}/out"
    before, seen = {}, []
    for number in range(4):
        events.round(number)
        events.start(out).awaitTermination()
        current = rows_of(status_changes.status_table(spark, out, 3).read())
        assert current == events.expected()
        moved = [(k, before.get(k), s) for k, s in current if before.get(k) != s]
        log = status_changes.status_log(spark, out)
        assert rows_of(log.filter(f"batch = {number}").drop("batch")) == sorted(moved, key=lambda r: r[0])
        assert moved and (number == 0 or len(moved) < len(current))
        before, seen = dict(current), seen + moved
    assert len({s for *_, s in seen}) == 5
    # A lost commit: the micro-batch comes again and changes nothing.
    lose_commit(folder, 3)
    events.start(out).awaitTermination()
    assert rows_of(status_changes.status_table(spark, out, 3).read()) == events.expected()
    assert status_changes.status_log(spark, out).count() == len(seen)


def test_events_that_change_no_status_are_not_logged(spark, folder):
    events, out = Events(spark, folder, 3), f"{folder}/out"
    frame = spark.createDataFrame
    for name, rows in (("opened", [(1,), (2,)]), ("lines", [(1, 10, 1, 0, 1)]), ("decisions", [(9, REFUSED, 1)]), ("labor", [])):
        frame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}/n=0")
    events.start(out).awaitTermination()
    frame([(1, 10, 2, 0, 1)], LINES).coalesce(1).write.parquet(f"{folder}/lines/n=1")
    events.start(out).awaitTermination()
    log = status_changes.status_log(spark, out)
    assert sorted(r.order_id for r in log.collect()) == [1, 2]
