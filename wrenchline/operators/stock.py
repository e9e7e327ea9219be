"""Stock on order: reordering approved parts and matching arrivals with waiting order lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchline.operators.maintenance import increment_by_key, upsert
from wrenchline.operators.receipt_fold import decide_receipts
from wrenchline.operators.skew import (
    BROADCAST_ROWS, Ordinary, by_route, hot_keys, lookup_join, running_totals, sized,
)
from wrenchline.session import pinned

PART = ["part_code"]
LINE_ORDER = ("requested", "order_id", "line_no")
# Receipts of one part handled by one task in one round; further ones go to further rounds.
PAGE = 1_000_000
# Newest lines of a part in one bin, and arrivals that meet a bin in one task.
BIN_RANKS = 4096
BLOCK_ARRIVALS = 1024


def by_number(column: str) -> Column:
    """Sort value for codes that are numbers kept as text; other codes follow in text order."""
    return F.struct(F.col(column).cast("string").try_cast("bigint").isNull(),
                    F.col(column).cast("string").try_cast("bigint"), F.col(column))


def line_order(lines: DataFrame, newest_first: bool = False) -> list[Column]:
    """Request date, then order id and line number as the tie-break."""
    columns = [c for c in LINE_ORDER if c in lines.columns]
    first = F.col(columns[0]).desc() if newest_first else F.col(columns[0])
    return [first, *[F.col(c) for c in columns[1:]]]


# --- reordering ---------------------------------------------------------------------------------

def supplier_of_part(catalog: DataFrame) -> DataFrame:
    """One supplier per part code: that of the lowest version."""
    return catalog.groupBy("part_code").agg(F.min_by("supplier", "version").alias("supplier"))


def ordered_parts(lines: DataFrame, approvals: DataFrame, catalog: DataFrame,
                  dedupe: bool = False) -> DataFrame:
    """(part_code, quantity, supplier) to order for a batch of approvals (order_id, …).

    A repeated approval orders again, unless ``dedupe``. Parts without a catalogue row are dropped.
    """
    times = approvals.groupBy("order_id").agg((F.lit(1) if dedupe else F.count("*")).alias("_times"))
    wanted = lookup_join(lines.select("order_id", "part_code", "needed"), times, ["order_id"])
    per_part = wanted.groupBy("part_code").agg(F.sum(F.col("needed") * F.col("_times")).alias("quantity"))
    return per_part.join(supplier_of_part(catalog), "part_code")


def reorder_existing(pending: DataFrame, lines: DataFrame, approvals: DataFrame,
                     catalog: DataFrame) -> DataFrame:
    """Pending stock with approved quantities added to parts already on order; no new rows."""
    wanted = ordered_parts(lines, approvals, catalog)
    return increment_by_key(pending, wanted, PART, "quantity")


def reorder_new(pending: DataFrame, lines: DataFrame, approvals: DataFrame, catalog: DataFrame) -> DataFrame:
    """New pending rows: approved parts not on order yet."""
    wanted = ordered_parts(lines, approvals, catalog)
    return wanted.join(pending.select("part_code"), "part_code", "left_anti")


def pending_stock(pending: DataFrame, lines: DataFrame, approvals: DataFrame, catalog: DataFrame,
                  dedupe: bool = False) -> DataFrame:
    """Pending stock after a batch of approvals: existing parts grow, new parts are added."""
    return upsert(pending.select("part_code", "quantity", "supplier"),
                  ordered_parts(lines, approvals, catalog, dedupe), PART, ["quantity"])


# --- one arrival per part -----------------------------------------------------------------------

def waiting_lines(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("available") == 0) & F.col("part_code").isNotNull())


def hot_parts(lines: DataFrame) -> list[int]:
    return hot_keys(waiting_lines(lines), PART)


def idle_lines(lines: DataFrame) -> DataFrame:
    """Lines no arrival can touch; they are never shuffled."""
    return lines.filter(F.coalesce(F.col("available") != 0, F.lit(True)) | F.col("part_code").isNull())


def waiting_totals(waiting: DataFrame, parts: DataFrame, route: Ordinary) -> DataFrame:
    """Waiting lines of the given parts (one row per part, its columns are carried along) with ``running``:
    needed quantity up to the line, oldest first. Lines of other parts are dropped before the shuffle."""
    touched = route.join(waiting, parts)
    return route.running_totals(touched, line_order(waiting), {"running": F.coalesce("needed", F.lit(0))})


def _supplied(lines: DataFrame, goals: DataFrame) -> DataFrame:
    """All lines, where the oldest waiting ones of each part in ``goals`` (part_code, _goal; one row per part) become
    available = needed, up to the last at which the running total equals the goal.

    Quantities may be negative, so that a total can be reached more than once: lines are marked by rank.
    """
    def supply(waiting: DataFrame, route: Ordinary) -> DataFrame:
        run = route.running_totals(route.join(waiting, goals, "left"), line_order(waiting),
                                   {"running": F.coalesce("needed", F.lit(0)), "_rank": F.lit(1)})
        run = route.key_maximum(run, F.when(F.col("running") == F.col("_goal"), F.col("_rank")), "_last")
        available = F.when(F.col("_rank") <= F.col("_last"), F.col("needed")).otherwise(F.col("available"))
        return run.withColumn("available", available).select(*lines.columns)

    return by_route(waiting_lines(lines), PART, supply).unionByName(idle_lines(lines))


def allocate_fifo(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """All lines after one arrival (part_code, arrived) per part.

    The oldest waiting lines whose needed quantities sum exactly to the arrival become supplied
    (available = needed); without such a prefix nothing changes. One shuffle by part of the waiting lines.
    Several arrivals of a part have an order and depend on each other: they are refused with an error, and
    ``allocate_receipts`` is for them.
    """
    again = F.raise_error(F.lit("a part has several arrivals: use allocate_receipts")).cast("bigint")
    arrived = receipts.filter(F.col("arrived") > 0).groupBy("part_code").agg(
        F.max("arrived").alias("_most"), F.count("*").alias("_n"))
    return _supplied(lines, sized(arrived.select(
        "part_code", F.when(F.col("_n") > 1, again).otherwise(F.col("_most")).alias("_goal"))))


# --- sequences of arrivals ----------------------------------------------------------------------

def receipt_decisions(lines: DataFrame, state: DataFrame, receipts: DataFrame, page: int = PAGE,
                      hot: list[int] | None = None) -> DataFrame:
    """What each receipt (part_code, seq, arrived) of a sequence does; ``seq`` is unique within a part.

    ``state`` is the stock on order: part_code, quantity and optionally ``start``, the position in the part's
    running total of waiting lines up to which earlier receipts supplied them.
    Result columns: part_code, seq, arrived, outcome, from_total, to_total, and ``quantity`` on order afterwards.

    A receipt depends on those before it, so a part's receipts are decided in order, parts in parallel.
    Only the facts this needs travel: the receipts and the distinct running totals within reach.
    A task gets at most ``page`` receipts of a part per round, and the totals these can reach.
    ``hot`` is for callers that know the hot parts of ``lines`` already (see ``hot_parts``).
    """
    hot = hot_parts(lines) if hot is None else hot
    needed = F.coalesce("needed", F.lit(0))
    per_part = receipts.groupBy("part_code").agg(F.count("*").alias("n"))
    size = per_part.agg(F.max("n").alias("most"), F.count("*").alias("parts")).first()
    most, few = size["most"] or 0, size["parts"] <= BROADCAST_ROWS
    # When few parts receive, lines of other parts are dropped before any shuffle.
    touched = lines.join(F.broadcast(per_part.select("part_code")), PART, "left_semi") if few else lines
    facts = touched.groupBy("part_code").agg(
        F.sum(F.when(F.col("available") == 0, needed)).cast("bigint").alias("total"),
        F.count_if((F.col("available") == 0) & (F.col("needed") == 0)).alias("zero_lines"))

    def totals(limits: DataFrame) -> DataFrame:
        limits = F.broadcast(limits) if few else limits
        return by_route(waiting_lines(lines), PART, lambda rows, route: waiting_totals(rows, limits, route), hot)

    state = starting_state(state)
    if most <= page:
        return decide_receipts(totals, facts, state, receipts)

    numbered = pinned(running_totals(receipts, PART, [F.col("seq")], {"_nr": F.lit(1)}))
    state = pinned(state)
    rounds = []
    for first in range(0, most, page):
        batch = numbered.filter((F.col("_nr") > first) & (F.col("_nr") <= first + page)).drop("_nr")
        rounds.append(pinned(decide_receipts(totals, facts, state, batch)))
        state = pinned(state_after(state, rounds[-1]))
    return reduce(DataFrame.unionByName, rounds)


def starting_state(pending: DataFrame) -> DataFrame:
    start = F.col("start") if "start" in pending.columns else F.lit(0)
    return pending.select("part_code", F.col("quantity").cast("bigint").alias("quantity"),
                          start.cast("bigint").alias("start"))


def state_after(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stock on order and position per part after the decisions."""
    last = decisions.groupBy("part_code").agg(
        F.max("to_total").alias("_start"), F.max_by("quantity", "seq").alias("_quantity"))
    return state.join(last, "part_code", "left").select(
        "part_code", F.coalesce("_quantity", "quantity").alias("quantity"),
        F.coalesce("_start", "start").alias("start"))


def allocate_receipts(lines: DataFrame, pending: DataFrame, receipts: DataFrame,
                      page: int = PAGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, pending, decisions) after a sequence of receipts per part.

    All three results read the decisions, so these are computed once and stored.
    """
    decisions = pinned(receipt_decisions(lines, pending, receipts, page))
    return supplied_lines(lines, decisions), stock_after(pending, decisions), decisions


def supplied_lines(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """All lines, with those the decisions reach marked supplied."""
    upto = decisions.groupBy("part_code").agg(F.max("to_total").alias("_goal")).filter(F.col("_goal") > 0)
    return _supplied(lines, sized(upto))


def stock_after(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    last = decisions.groupBy("part_code").agg(F.max_by("quantity", "seq").alias("_quantity"))
    joined = pending.join(last, "part_code", "left")
    return joined.withColumn("quantity", F.coalesce("_quantity", "quantity")).drop("_quantity")


def unmatched_receipts(decisions: DataFrame) -> DataFrame:
    """Receipts without effect and why."""
    return decisions.filter(F.col("outcome").startswith("refused")).select(
        "part_code", "seq", "arrived", F.col("outcome").alias("reason"))


# --- reading back the newest assignments ---------------------------------------------------------

def _newest_supplied(lines: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Supplied lines of the parts asked for, numbered once per part: ``rank``, newest first, and ``upto``, what the
    lines so far were supplied."""
    parts = arrivals.select("part_code").distinct()

    def ranked(supplied: DataFrame, route: Ordinary) -> DataFrame:
        return route.running_totals(route.join(supplied, parts, "left_semi"), line_order(supplied, newest_first=True),
                                    {"upto": F.col("available"), "rank": F.lit(1)})

    return by_route(lines.filter(F.col("available") != 0), PART, ranked)


def _prefix_sizes(newest: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(part_code, arrived, k) of the distinct arrivals that some number of newest lines sums to."""
    asked = arrivals.select("part_code", "arrived").distinct()
    reached = newest.select("part_code", F.col("upto").alias("arrived"), "rank")
    return reached.join(asked, ["part_code", "arrived"]).groupBy("part_code", "arrived").agg(F.max("rank").alias("k"))


def recent_prefix_size(lines: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals (part_code, arrived; any number per part) with ``k``: the most of the newest supplied lines that sum
    to ``arrived``; 0 when there is no such number of lines."""
    found = _prefix_sizes(_newest_supplied(lines, arrivals), arrivals)
    return arrivals.join(found, ["part_code", "arrived"], "left").withColumn(
        "k", F.coalesce("k", F.lit(0).cast("bigint")))


def _rank_bin(rank: Column, width: int) -> Column:
    """Bins of ranks 1, 2-3, 4-7, ... up to ``width`` ranks a bin (a power of two), then all of that width."""
    bits = width.bit_length() - 1
    return F.when(rank < width, F.length(F.bin(rank)) - 1).otherwise(
        F.shiftright(rank, bits) + (bits - 1)).cast("bigint")


def _within_reach(newest: DataFrame, sizes: DataFrame, width: int, block: int) -> DataFrame:
    """Pairs of an arrival of ``sizes`` and a line of a bin in which the arrival has lines.

    These are fewer than twice the lines the arrivals have, because an arrival's last bin is no wider than the bins
    before it. A task's key holds at most ``width`` lines and about ``block`` arrivals: a bin in which more arrivals
    have lines is copied once per block of them.
    """
    at = ["part_code", "_bin"]
    reach = sizes.withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("bigint"), _rank_bin(F.col("k"), width))))
    blocks = reach.groupBy(*at).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    binned = newest.withColumn("_bin", _rank_bin(F.col("rank"), width)).join(blocks, at)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    dealt = reach.join(blocks, at).withColumn("_block", F.pmod(F.xxhash64("arrived"), F.col("_blocks")))
    return binned.withColumn("_block", copies).drop("_blocks").join(dealt.drop("_blocks"), [*at, "_block"])


def recent_assignments(lines: DataFrame, arrivals: DataFrame, width: int = BIN_RANKS,
                       block: int = BLOCK_ARRIVALS) -> DataFrame:
    """The lines each distinct recent arrival went to, newest first: part_code, arrived, order_id, quantity, rank.

    Any number of arrivals per part: lines meet arrivals by bins of ranks, see ``_within_reach``.
    """
    asked = pinned(arrivals.select("part_code", "arrived").distinct())
    newest = _newest_supplied(lines, asked).select("part_code", "order_id", "available", "upto", "rank")
    found = _within_reach(newest, pinned(_prefix_sizes(newest, asked)), width, block)
    return found.filter(F.col("rank") <= F.col("k")).select(
        "part_code", "arrived", "order_id", F.col("available").alias("quantity"), "rank")
