"""Small helpers of several operators."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh_name(name: str, taken: Sequence[str]) -> str:
    """``name`` with underscores in front until no column has it (in any case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def release_memory() -> None:
    """Give back what earlier tasks of this Python worker have freed; a worker serves many stages and keeps it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def fold(ids: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id is in fold 0."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> DataFrame:
    """At most ``rows`` rows (``doc_id``, ``text``, ``label`` 0 or 1), half of each label where there are enough.

    ``labels`` holds what may be learned from. Documents are taken in the order of a hash of their id, without those of
    more than ``longest`` characters, so the sample is the same in every run and of a bounded size.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.col("text").isNotNull() & (F.length("text") <= longest))
    known = known.join(texts.select("doc_id"), "doc_id")
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for k in (0, 1)]
    return texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
