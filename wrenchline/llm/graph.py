"""Connected components of a link table: hooking and pointer jumping by joins and grouped minima until the contracted
links fit one task of a fixed size, which finishes them by union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchline.session import pinned

#: Links that one task takes, 16 bytes each.
TASK_LINKS = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and that smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array(parent, np.int64)
    while len(root) and (root != root[root]).any():
        root = root[root]
    below = np.flatnonzero(root < np.arange(len(root)))
    return nodes[below], nodes[root[below]]


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if got:
        nodes, roots = union_find(*(np.concatenate(side) for side in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "comp"])


def _jumped(parents: DataFrame) -> DataFrame:
    """Follow parents (``node``, ``comp``; comp < node) to their roots; each step halves the depth."""
    while True:
        above = parents.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        step = pinned(parents.join(above, "comp", "left")
                      .select("node", F.coalesce("_up", "comp").alias("comp"), F.col("_up").isNotNull().alias("_moved")))
        moved = step.filter("_moved").limit(1).count()
        parents = step.drop("_moved")
        if not moved:
            return parents


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """Rows (``node``, ``comp``) for every node of ``links`` (``a``, ``b``: long) whose component has a smaller node.

    ``comp`` is the smallest node reachable. Nodes without a row are the smallest of their component. Each round
    hooks every node onto its smallest smaller neighbour and contracts the links, which at least halves the nodes
    that still have links; nothing is collected but counts.
    Nulls and self links are ignored, repeated links change nothing, and an empty table gives no rows.
    """
    found: DataFrame | None = None
    links = links.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        links = pinned(links.distinct())
        left = links.count()
        if not left:
            break
        if left <= task_links:
            parents = pinned(links.repartition(1).mapInArrow(_in_task, "node long, comp long"))
        else:
            parents = _jumped(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")))
        if found is None:
            found = parents
        else:
            later = parents.select(F.col("node").alias("comp"), F.col("comp").alias("_root"))
            found = (found.join(later, "comp", "left").select("node", F.coalesce("_root", "comp").alias("comp"))
                     .unionByName(parents))
        if left <= task_links:
            break
        roots = {side: parents.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}")) for side in "ab"}
        links = (links.join(roots["a"], "a", "left").join(roots["b"], "b", "left")
                 .select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")).filter("x <> y")
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")) if found is None else pinned(found)
