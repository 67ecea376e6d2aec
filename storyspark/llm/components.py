"""Connected components of an edge table.

Each partition first replaces its edges by a spanning star forest (union-find). While more than ``ONE_TASK`` edges are
left, alternating large-star and small-star steps (Kiveris et al., 2014) contract the graph by joins; what then fits one
task of bounded memory is finished there. The result is the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import discard, materialize


#: Edges (some 200 bytes each in union-find) that one task may finish.
ONE_TASK = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars: (node, least node of its tree); edges are taken in pieces of ``ONE_TASK``."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in parent]
        rows = [(x, r) for x, r in rows if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 2 * ONE_TASK:
            yield stars()
    yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` to ``(node, component)``: the smallest node that each node reaches; nodes without edges have no row."""
    edges = materialize(edges.where("u != v").select("u", "v").mapInArrow(_forest, "u long, v long"))
    n, before = edges.count(), None
    while n > ONE_TASK:
        half = materialize(_large_star(edges))
        after = materialize(_small_star(half))
        discard(half, edges)
        edges, now = after, _state(after)
        if now == before:
            break
        n, before = now[0], now
    else:
        edges = materialize(edges.coalesce(1).mapInArrow(_forest, "u long, v long"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
