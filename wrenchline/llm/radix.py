"""Ranks of all rows by a distributed least-significant-digit radix sort.

Rows lie in blocks of at most ``BLOCK_ROWS`` rows. A pass sorts by one digit of the composite key: the counts of each
(block, digit) become global offsets by prefix sums, first over the digits and within a digit over the blocks; a block
then sorts its own rows stably by counting and knows each row's destination, hence its next block. The one shuffle of a
pass takes rows to their blocks. After the pass of the most significant digit the place of a row is its rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wrenchline.session import pinned

BLOCK_ROWS = 1 << 16
#: A digit has at most so many bits, so a block has at most 4,096 counts.
DIGIT_BITS = 12


def _dealt(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            at = np.arange(seen, seen + len(batch))
            seen += len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + at // block_rows), pa.array(at % block_rows), *batch.columns],
                ["block", "at", *batch.schema.names])

    return run


def _moved(key: str, shift: int, bits: int, block_rows: int):
    def run(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        placed = np.empty(len(rows), np.int64)
        placed[rows.column("at").to_numpy()] = np.arange(len(rows))
        rows = rows.take(pa.array(placed))
        digit = ((rows.column(key).to_numpy() >> shift) & ((1 << bits) - 1)).astype(np.uint16)
        order = np.argsort(digit, kind="stable")  # numpy counts 16-bit values instead of comparing them
        starts = np.zeros(1 << bits, np.int64)
        starts[offsets.column("digit").to_numpy()] = offsets.column("offset").to_numpy()
        firsts = np.concatenate([[0], np.cumsum(np.bincount(digit, minlength=1 << bits))[:-1]])
        sorted_digit = digit[order]
        to = starts[sorted_digit] + np.arange(len(rows)) - firsts[sorted_digit]
        rows = rows.take(pa.array(order))
        return pa.table({"block": to // block_rows, "at": to % block_rows,
                         **{n: rows.column(n) for n in rows.column_names if n not in ("block", "at")}})

    return run


def _digits(rows: DataFrame, keys: Sequence[str], digit_bits: int) -> list[tuple[str, int, int]]:
    """(key, shift, bits) of each pass, least significant first; one pass at least, which closes the gaps of blocks."""
    tops = rows.agg(*[F.max(k).alias(k) for k in keys]).first()
    passes = []
    for key in reversed(keys):
        bits = int(tops[key] or 0).bit_length()
        n = -(-bits // digit_bits)
        passes += [(key, i * digit_bits, min(digit_bits, bits - i * digit_bits)) for i in range(n)]
    return passes or [(keys[-1], 0, 1)]


def radix_ranks(rows: DataFrame, keys: Sequence[str], carried: str, block_rows: int = BLOCK_ROWS,
                digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Rows (``carried``, ``rank``), rank 1 for the least key.

    ``keys``, most significant first, are longs, not null and not negative; ``carried`` is a long. Rows with equal keys
    get different ranks in any order. An empty table gives no rows. ``rows`` is read several times: store it before.
    """
    rows = rows.select(*keys, carried)
    fields = ", ".join(f"{c} long" for c in ("block", "at", *keys, carried))
    placed = pinned(rows.mapInArrow(_dealt(block_rows), fields))
    for key, shift, bits in _digits(rows, keys, digit_bits):
        digit = F.shiftright(key, shift).bitwiseAND((1 << bits) - 1).cast("int").alias("digit")
        counts = placed.groupBy("block", digit).agg(F.count("*").alias("n"))
        # At most 2 ** digit_bits rows: the one window without a partition is bounded.
        below = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
            "digit", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
        before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
            F.broadcast(bases), "digit").select(F.col("block").alias("to_block"), "digit", (F.col("base") + F.col("before")).alias("offset"))
        placed = pinned(placed.groupBy("block").cogroup(offsets.groupBy("to_block")).applyInArrow(
            _moved(key, shift, bits, block_rows), fields))
    return placed.select(carried, (F.col("block") * block_rows + F.col("at") + 1).alias("rank"))
