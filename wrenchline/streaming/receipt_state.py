"""Receipts matched with waiting lines in state that the streaming engine keeps.

Calls into the state cost more than what they carry, so parts lie together: the engine's key is a bucket, which holds
shelves of parts, and a shelf is one value with stock on order, position and the running totals of the first waiting
lines of its parts. The totals of later lines are pages, a map from part and page to sorted totals. The lines table is
read once, as the initial state; a receipt reads its shelf and, for a part with many lines, the one page in which its
goal lies, so a micro-batch costs what it brings, whatever the number of lines. Totals behind the position are removed.
Decisions leave as an ordinary stream, and the sink makes them exactly-once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

from wrenchline.operators.receipt_fold import DECISION_SCHEMA, PartFold
from wrenchline.operators.skew import by_route
from wrenchline.operators.stock import PART, line_order, starting_state, waiting_lines

#: A page holds the totals of so many consecutive numbers, hence at most so many totals.
PAGE_SPAN = 4096
#: A part's first waiting lines, whose totals lie on its shelf.
NEAR_LINES = 64
#: Keys of the state and shelves of a key. A checkpoint belongs to these numbers.
BUCKETS = 2048
SHELVES = 64
#: What a shelf says of a part, in this order, as 64-bit numbers, and what it says of an unknown one.
FACTS = {"quantity": 0, "position": 0, "total": 0, "zero_lines": 0, "on_order": False, "has_lines": False}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

# The processor travels with its tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need a state store with column families."""
    if spark.conf.get(STATE_STORE) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


class Shelf:
    """The parts of one shelf: facts, whether they have pages, and the totals of their first lines."""

    def __init__(self, stored=None):
        self.places, self.facts, self.paged, self.near = {}, [], [], []
        if stored is not None:
            codes, facts, totals = stored
            table = np.frombuffer(facts, np.int64).reshape(len(codes), len(FACTS) + 2)
            self.places = {code: place for place, code in enumerate(codes)}
            self.facts = table[:, :len(FACTS)].tolist()
            self.paged = table[:, -2].tolist()
            self.near = np.split(np.frombuffer(totals, np.int64), np.cumsum(table[:, -1])[:-1])

    def put(self, code: str, facts: list[int] | None, totals: np.ndarray, paged: bool) -> None:
        """A part's facts and first totals, or (``facts`` None) only that it has pages, in any order."""
        place = self.places.get(code)
        if place is None:
            place = self.places[code] = len(self.facts)
            self.facts.append([0] * len(FACTS))
            self.paged.append(0)
            self.near.append(np.empty(0, np.int64))
        if facts is not None:
            self.facts[place], self.near[place] = facts, totals
        if paged:
            self.paged[place] = 1

    def move(self, code: str, quantity: int, position: int) -> None:
        place = self.places[code]
        self.facts[place][:2] = quantity, position
        self.near[place] = self.near[place][self.near[place] > position]

    def stored(self) -> tuple[list[str], bytes, bytes]:
        rows = [[*facts, paged, len(near)] for facts, paged, near in zip(self.facts, self.paged, self.near, strict=True)]
        return list(self.places), np.array(rows, np.int64).tobytes(), np.concatenate(self.near).tobytes()


class Totals:
    """The totals of one part: those on its shelf, and the others looked up page by page."""

    def __init__(self, near: np.ndarray, code: str, pages=None):
        self.near, self.code, self.pages = frozenset(near.tolist()), code, pages
        self.number, self.totals = None, frozenset()

    def __contains__(self, total: int) -> bool:
        if total in self.near:
            return True
        if self.pages is None:
            return False
        number = total // PAGE_SPAN
        if number != self.number:
            at = (self.code, number)
            found = self.pages.getValue(at)[0] if self.pages.containsKey(at) else b""
            self.number, self.totals = number, frozenset(np.frombuffer(found, np.int64).tolist())
        return total in self.totals


class ReceiptProcessor(StatefulProcessor):
    """Decides the receipts of each part in the order of ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shelves = handle.getMapState("shelves", "shelf int", "codes array<string>, facts binary, totals binary")
        self.pages = handle.getMapState("pages", "code string, page bigint", "totals binary")
        self.loading, self.filled = None, set()

    def _shelf(self, number: int) -> Shelf:
        return Shelf(self.shelves.getValue((number,)) if self.shelves.containsKey((number,)) else None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A bucket's state comes in one table or, when it is large, in several."""
        if key != self.loading:
            self.loading, self.filled = key, set()
        state = initialState.sort_values("shelf", kind="stable")
        rows = zip(state["shelf"].tolist(), state["code"].tolist(), state["page"].tolist(),
                   state[list(FACTS)].astype("int64").to_numpy().tolist(), state["totals"].tolist(), strict=True)
        for number, parts in groupby(rows, key=itemgetter(0)):
            shelf = self._shelf(number) if number in self.filled else Shelf()
            for _, code, page, facts, totals in parts:
                totals = np.asarray(totals, np.int64)
                if page < 0:
                    shelf.put(code, facts, totals, False)
                else:
                    shelf.put(code, None, totals, True)
                    self.pages.updateValue((code, page), (totals.tobytes(),))
            self.shelves.updateValue((number,), shelf.stored())
            self.filled.add(number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        receipts = pd.concat(rows).sort_values(["shelf", "code", "no_seq", "seq"])
        arriving = zip(*(receipts[c].tolist() for c in (
            "shelf", "code", "part_code", "seq", "no_seq", "arrived", "unknown")), strict=True)
        out: list[tuple] = []
        for number, on_shelf in groupby(arriving, key=itemgetter(0)):
            shelf, moved = self._shelf(number), False
            for code, bids in groupby(on_shelf, key=itemgetter(1)):
                moved |= self._settle(shelf, code, list(bids), out)
            if moved:
                self.shelves.updateValue((number,), shelf.stored())
        kinds = {c: "Int64" for c in ("arrived", "from_total", "to_total", "quantity")}
        kinds |= {c: "Int64" if receipts[c].dtype.kind == "i" else receipts[c].dtype for c in ("part_code", "seq")}
        decided = pd.DataFrame(out, columns=["part_code", "seq", "arrived", "outcome", "from_total", "to_total",
                                             "quantity"], dtype=object)
        yield decided.astype(kinds)

    def _settle(self, shelf: Shelf, code: str, bids: list[tuple], out: list[tuple]) -> bool:
        """Decide one part's receipts; whether its stock or position changed."""
        held = code in shelf.places
        place = shelf.places.get(code)
        quantity, position, total, zero_lines, on_order, has_lines = shelf.facts[place] if held else (0,) * len(FACTS)
        quantity = quantity if on_order else None
        fold = PartFold(bids[0][2], position, quantity, total, zero_lines if has_lines else None)
        fold.stops = Totals(shelf.near[place], code, self.pages if shelf.paged[place] else None) if held else ()
        fold.bids = [(None if no_seq else seq, None if unknown else arrived)
                     for _, _, _, seq, no_seq, arrived, unknown in bids]
        fold.settle(None, out)
        if (fold.quantity, fold.at) == (quantity, position):
            return False
        shelf.move(code, fold.quantity, fold.at)
        if shelf.paged[place]:
            for page in range(position // PAGE_SPAN, fold.at // PAGE_SPAN):
                if self.pages.containsKey((code, page)):
                    self.pages.removeKey((code, page))
        return True

    def close(self) -> None:
        pass


def initial_pages(lines: DataFrame, pending: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """The state before the first receipt: a row per part (page -1) with the totals of its first waiting lines, and a row
    per page of the totals of later lines.

    Parts that are not on order have no totals, because no receipt of theirs can be applied. ``hot`` as in ``by_route``.
    """
    needed = F.coalesce("needed", F.lit(0))
    state = starting_state(pending)
    facts = lines.groupBy("part_code").agg(
        F.sum(F.when(F.col("available") == 0, needed)).cast("bigint").alias("total"),
        F.count_if((F.col("available") == 0) & (F.col("needed") == 0)).alias("zero_lines"))
    head = F.struct(
        F.col("quantity").isNotNull().alias("on_order"), F.coalesce("quantity", F.lit(0)).alias("quantity"),
        F.coalesce("start", F.lit(0)).alias("position"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("zero_lines", F.lit(0)).alias("zero_lines"), F.coalesce("has_lines", F.lit(False)).alias("has_lines"))
    on_shelf = F.lit(-1).cast("bigint")
    heads = state.join(facts.withColumn("has_lines", F.lit(True)), "part_code", "left").select(
        "part_code", on_shelf.alias("page"), head.alias("head"), F.lit(None).cast("bigint").alias("running"))
    starts = state.filter(F.col("quantity").isNotNull()).select("part_code", F.col("start").alias("_start"))

    def totals(waiting: DataFrame, route) -> DataFrame:
        run = route.running_totals(route.join(waiting, starts), line_order(waiting),
                                   {"running": needed, "_rank": F.lit(1)})
        page = F.when(F.col("_rank") > NEAR_LINES, F.floor(F.col("running") / PAGE_SPAN)).otherwise(on_shelf)
        return run.filter(F.col("running") > F.col("_start")).select(
            "part_code", page.alias("page"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "running")

    # A page holds at most PAGE_SPAN distinct numbers, so a part with very many lines has many small groups.
    rows = by_route(waiting_lines(lines), PART, totals, hot).unionByName(heads).groupBy("part_code", "page").agg(
        F.max("head").alias("head"), F.sort_array(F.collect_set("running")).alias("totals"))
    return rows.select(
        "part_code", "page", *[F.coalesce(f"head.{c}", F.lit(nothing)).alias(c) for c, nothing in FACTS.items()], "totals")


def _places(code: Column) -> list[Column]:
    """Columns that say where the state of a part lies."""
    place = F.pmod(F.xxhash64(code), F.lit(BUCKETS * SHELVES))
    return [code.alias("code"), (place % BUCKETS).cast("int").alias("bucket"),
            F.floor(place / BUCKETS).cast("int").alias("shelf")]


def receipts_in_state(stream: DataFrame, lines: DataFrame, pending: DataFrame) -> DataFrame:
    """Arrival events (part_code, seq, arrived) to decisions, the columns of ``receipt_decisions``.

    Equal to the batch operator when the receipts of a part arrive in the order of ``seq``; within a micro-batch they
    are put in that order. ``lines`` and ``pending`` are read when the stream starts; after a restart the engine goes on
    with its own state. Receipts without a part are left out.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    part, seq = (stream.schema[c].dataType for c in ("part_code", "seq"))
    # A table of numbers with a missing one would become floats.
    number = F.coalesce("seq", F.lit(0).cast(seq)) if isinstance(seq, IntegralType) else F.col("seq")
    events = stream.filter(F.col("part_code").isNotNull()).select(
        *_places(F.col("part_code").cast("string")), "part_code", number.alias("seq"), F.col("seq").isNull().alias("no_seq"),
        F.coalesce("arrived", F.lit(0)).cast("bigint").alias("arrived"), F.col("arrived").isNull().alias("unknown"))
    initial = initial_pages(lines, pending).withColumn("part_code", F.col("part_code").try_cast(part)) \
        .filter(F.col("part_code").isNotNull()) \
        .select(*_places(F.col("part_code").cast("string")), "page", *FACTS, "totals")
    return events.groupBy("bucket").transformWithStateInPandas(
        ReceiptProcessor(), DECISION_SCHEMA.format(part=part.simpleString(), seq=seq.simpleString()), "append", "none",
        initial.groupBy("bucket"))
