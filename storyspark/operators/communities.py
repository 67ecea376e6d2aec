"""Louvain communities by bulk-synchronous moves: every step is a join and an aggregate over edge and label tables, and no group holds a graph.

A round finds every node's neighbouring community of greatest gain and moves a share of the nodes that have one (by a hash of
node and round). Nodes that move at once may hinder one another, so a round counts only if modularity rises; when it does not,
a smaller share of the same moves is tried. When no node gains, the communities become the nodes of the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.operators.graph_algorithms import cut

#: Shares of the moves that are tried (one node in so many), rounds of a level and levels at most.
SHARES, ROUNDS, LEVELS = (1, 2, 8, 64), 64, 40
#: Gain of modularity below which a round does not count.
LEAST = 1e-5


def _matrix(edges: DataFrame) -> DataFrame:
    """(u, v, w) of both directions of ``edges(a, b, w)``, parallel edges summed; a loop counts twice, as its two ends do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    return both.groupBy("u", "v").agg(F.sum(F.col("w").cast("double")).alias("w"))


def _modularity(links: DataFrame, state: DataFrame, m2: float) -> float:
    """Modularity of the labels ``state(node, comm, k)``."""
    x, y = state.select(F.col("node").alias("u"), F.col("comm").alias("cu")), state.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
    inside = links.join(x, "u").join(y, "v").where("cu = cv").agg(F.sum("w").alias("s"))
    total = state.groupBy("comm").agg(F.sum("k").alias("t")).agg((-F.sum(F.col("t") * F.col("t")) / m2).alias("s"))
    return sum(r["s"] or 0.0 for r in inside.unionAll(total).collect()) / m2  # two rows


def _moves(links: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """(node, to) of the nodes that gain in another community: the one of greatest gain, of equals the least label."""
    near = links.where("u <> v").join(state.select(F.col("node").alias("v"), F.col("comm").alias("c")), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
    # home counts with weight 0 too, so that it is a choice for a node without a neighbour in it
    near = near.unionAll(state.select(F.col("node").alias("u"), F.col("comm").alias("c"), F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
    total = state.groupBy(F.col("comm").alias("c")).agg(F.sum("k").alias("t"))
    told = near.join(total, "c").join(state.select(F.col("node").alias("u"), F.col("comm").alias("own"), "k"), "u")
    home = F.col("c") == F.col("own")
    told = told.withColumn("gain", F.col("w") - (F.col("t") - F.when(home, F.col("k")).otherwise(0.0)) * F.col("k") / F.lit(m2))
    best = told.groupBy("u").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("to"), F.max("gain").alias("best"), F.max(F.when(home, F.col("gain"))).alias("stay"))
    return best.where(F.col("best") > F.col("stay") + 1e-9 * m2).select(F.col("u").alias("node"), "to")


def louvain(edges: DataFrame) -> DataFrame:
    """(node, community, modularity) of undirected ``edges(a, b, w)`` with weights above 0; a community is named by its least node.

    The same edges give the same result. Repeated edges add up; a graph without edges has no communities (an empty result).
    """
    schema = "node long, community long, modularity double"
    edges = edges.where("w > 0 and a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w")
    links = cut(_matrix(edges))
    m2 = links.agg(F.sum("w")).first()[0]
    if not m2:
        return edges.sparkSession.createDataFrame([], schema)
    where, quality = None, None
    for _ in range(LEVELS):
        degree = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
        state = cut(degree.select("node", F.col("node").alias("comm"), "k"))
        began = quality = _modularity(links, state, m2) if quality is None else quality
        for turn in range(ROUNDS):
            moves = cut(_moves(links, state, m2))
            n = moves.count()
            for share in SHARES:
                some = moves.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(share)) == 0) if share > 1 else moves
                after = state.join(some, "node", "left").select("node", F.coalesce("to", "comm").alias("comm"), "k")
                q = _modularity(links, after, m2) if n and n >= share / 4 else quality
                if q > quality + LEAST:
                    break
            else:
                # no share of them helps: one node moves alone, which raises modularity by its gain
                after = state.join(moves.orderBy("node").limit(1), "node", "left").select("node", F.coalesce("to", "comm").alias("comm"), "k")
                q = _modularity(links, after, m2) if n else quality
            if q <= quality + LEAST:
                break
            state, quality = cut(after), q
        label = state.select(F.col("node").alias("was"), "comm")
        where = cut(label.select(F.col("was").alias("node"), "comm") if where is None else where.join(label, where["comm"] == label["was"]).select("node", label["comm"]))
        if quality <= began + LEAST:
            break
        x, y = state.select(F.col("node").alias("u"), F.col("comm").alias("cu")), state.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
        links = cut(links.join(x, "u").join(y, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    name = where.groupBy("comm").agg(F.min("node").alias("community"))
    return where.join(name, "comm").select("node", "community", F.lit(round(quality, 6)).alias("modularity"))
