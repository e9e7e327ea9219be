"""Deciding the receipts of each part in order, streamed through sorted partitions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

APPLIED = "applied"
APPLIED_NO_LINES = "applied, no line waits"
CORRECTED = "stock corrected"
NO_CHANGE = "refused: nothing arrived"
OVER_DELIVERY = "refused: more than on order"
NOT_ON_ORDER = "refused: part not on order"
NO_EXACT_PREFIX = "refused: no exact match"

DECISION_SCHEMA = ("part_code {part}, seq {seq}, arrived bigint, outcome string, from_total bigint, "
                   "to_total bigint, quantity bigint")
FLUSH_ROWS = 50_000

# The fold travels with its tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def decide_receipts(totals: Callable[[DataFrame], DataFrame], facts: DataFrame, state: DataFrame,
                    receipts: DataFrame) -> DataFrame:
    """Decisions for ``receipts`` (part_code, seq, arrived) from ``state`` (part_code, quantity, start).

    ``facts`` holds per part the total needed by waiting lines and the number of zero-quantity ones;
    ``totals`` gives the running totals of the parts in a table of limits. Per part the sorted stream reads: one
    header (kind 0), the receipts by seq (kind 1), the running totals in reach, ascending (kind 2).
    """
    part = receipts.schema["part_code"].dataType.simpleString()
    seq = receipts.schema["seq"].dataType.simpleString()
    nothing = F.lit(None).cast("bigint")
    # All receipts applied together take at most the stock on order plus what corrections return to it;
    # an unknown arrival takes all of that.
    reach = receipts.groupBy("part_code").agg(
        F.sum(F.greatest(F.coalesce("arrived", F.lit(0)), F.lit(0))).cast("bigint").alias("_reach"),
        F.sum(F.greatest(-F.coalesce("arrived", F.lit(0)), F.lit(0))).cast("bigint").alias("_returned"),
        F.count_if(F.col("arrived").isNull()).alias("_open"))
    asked = reach.join(state, "part_code", "left").join(facts, "part_code", "left")
    header = asked.select(
        "part_code", F.lit(0).alias("kind"), F.lit(None).cast(seq).alias("seq"),
        F.col("start").alias("a"), F.col("quantity").alias("b"), F.col("total").alias("c"),
        F.col("zero_lines").alias("d"))
    bids = receipts.select(
        "part_code", F.lit(1).alias("kind"), F.col("seq"), F.col("arrived").cast("bigint").alias("a"),
        nothing.alias("b"), nothing.alias("c"), nothing.alias("d"))
    most = F.col("quantity") + F.col("_returned")
    limits = reach.join(state, "part_code").filter(F.col("quantity").isNotNull()).select(
        "part_code", F.col("start").alias("_from"),
        (F.col("start") + F.when(F.col("_open") > 0, most).otherwise(F.least("_reach", most))).alias("_end"))
    stops = totals(limits) \
        .filter((F.col("running") > F.col("_from")) & (F.col("running") <= F.col("_end"))) \
        .select("part_code", "running").distinct() \
        .select("part_code", F.lit(2).alias("kind"), F.lit(None).cast(seq).alias("seq"),
                F.col("running").alias("a"), nothing.alias("b"), nothing.alias("c"), nothing.alias("d"))
    stream = header.unionByName(bids).unionByName(stops) \
        .repartition("part_code").sortWithinPartitions("part_code", "kind", "seq", "a")
    schema = _parse_datatype_string(DECISION_SCHEMA.format(part=part, seq=seq))
    return stream.mapInArrow(folder(to_arrow_schema(schema)), schema)


class PartFold:
    """Decides one part's receipts while its running totals stream by in ascending order."""

    def __init__(self, part, start, quantity, total, zero_lines):
        self.part = part
        self.at = start or 0
        self.quantity = quantity
        self.total = total or 0
        self.has_lines = zero_lines is not None
        self.zero_lines = zero_lines
        self.bids: list[tuple] = []
        self.next = 0
        self.stops: set[int] = set()

    def none_waits(self) -> bool:
        return self.zero_lines == 0 and self.at >= self.total

    def settle(self, seen: int | None, out: list[tuple]) -> None:
        """Decide receipts as far as totals up to ``seen`` allow; None means all totals are known."""
        while self.next < len(self.bids):
            seq, arrived = self.bids[self.next]
            before = self.at
            if self.quantity is None:
                outcome = NOT_ON_ORDER
            else:
                rest = 0 if arrived is None else self.quantity - arrived
                fallen = self.quantity - rest
                goal = self.at + fallen
                if rest < 0:
                    outcome = OVER_DELIVERY
                elif fallen == 0:
                    outcome = NO_CHANGE
                elif fallen < 0:
                    outcome, self.quantity = CORRECTED, rest
                elif self.has_lines and self.none_waits():
                    outcome, self.quantity = APPLIED_NO_LINES, rest
                elif goal in self.stops:
                    outcome, self.quantity, self.at = APPLIED, rest, goal
                elif seen is not None and seen < goal:
                    break
                else:
                    outcome = NO_EXACT_PREFIX
            self.next += 1
            out.append((self.part, seq, arrived, outcome, before, self.at, self.quantity))
        if seen is not None:
            self.stops = {s for s in self.stops if s > self.at}


def folder(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walk over a sorted stream; memory holds one part's receipts of the page and the totals ahead of it."""

    def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        fold: PartFold | None = None

        def packed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(column, type=field.type) for column, field in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            part, kinds, seq, a, b, c, d = batch.columns
            kinds = kinds.to_numpy()
            seq, a = seq.to_pylist(), a.to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for first, end in zip(edges, edges[1:]):
                if kinds[first] == 0:
                    for i in range(first, end):
                        if fold is not None:
                            fold.settle(None, out)
                        fold = PartFold(part[i].as_py(), a[i], b[i].as_py(), c[i].as_py(), d[i].as_py())
                elif kinds[first] == 1:
                    fold.bids.extend(zip(seq[first:end], a[first:end]))
                elif fold.next < len(fold.bids):
                    fold.stops.update(a[first:end])
                    if end == len(kinds):  # the part may go on in the next batch: let go of what is behind
                        fold.settle(a[end - 1], out)
                if len(out) >= FLUSH_ROWS:
                    yield packed()
        if fold is not None:
            fold.settle(None, out)
        if out:
            yield packed()

    return fold_batches
