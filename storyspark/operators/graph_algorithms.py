"""Graph algorithms on edge tables ``(a, b, w)``, undirected: ranks by DataFrame power iteration, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyspark.functions import words as W


def new_path(spark: SparkSession) -> str:
    """A new name in the shared folder of spark.checkpoint.dir (on one machine, where it is unset, in a temporary folder)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="storyspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/g{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration: ``df`` as a table in the shared folder."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def _ranks(nodes: DataFrame, move, damping: float, tolerance: float, most: int) -> DataFrame:
    """(node, rank) by power iteration over ``nodes(node, out)``; ``move`` gives (v, m), what each node is sent, from (node, share), a rank over its node's ``out``."""
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(most if n else 0):
        moved = move(ranks.where("out > 0").select("node", (F.col("rank") / F.col("out")).alias("share")))
        step = cut(ranks.withColumnRenamed("rank", "old").join(moved, F.col("node") == moved["v"], "left").select("node", "out", "old", F.coalesce("m", F.lit(0.0)).alias("m")))
        kept = step.agg(F.sum("m")).first()[0] or 0.0
        step = step.withColumn("rank", F.lit((1 - damping) / n + damping * (1 - kept) / n) + damping * F.col("m"))
        gap = step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        ranks = step.select("node", "out", "rank")
        if gap < n * tolerance:
            break
    return ranks.select("node", "rank")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank): weighted PageRank; isolated nodes of ``nodes(node)`` keep the teleport share and dangling mass is spread evenly."""
    links = cut(both_ways(edges))
    out = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").cast("double").alias("out"))
    out = cut(out if nodes is None else nodes.select("node").distinct().join(out, "node", "left"))
    move = lambda x: links.join(x, links["u"] == x["node"]).groupBy("v").agg(F.sum(F.col("share") * F.col("w")).alias("m"))
    return _ranks(out, move, damping, tolerance, most)


def textrank(rows: DataFrame, reach: int = 4, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank) of the words of ``rows(doc_id, i, tk)``, as ``pagerank`` has it on edges of weight ``reach`` + 1 - distance between different words ``reach`` places apart at most.

    The edges are never made: a word's sums over its neighbours are sums over its places, so a round sends each token to its word's
    rank and back to its text, not each pair of tokens.
    """
    text = Window.partitionBy("doc_id").orderBy("i")
    rows = cut(rows)

    def near(df: DataFrame, value: str) -> DataFrame:
        """(tk, s): the weighted sum of ``value`` over the other words around each place."""
        ways = [(way, k) for k in range(1, reach + 1) for way in (F.lag, F.lead)]
        at = df.select("tk", *[way(F.struct("tk", value), k).over(text).alias(f"n{i}") for i, (way, k) in enumerate(ways)])
        sums = [F.when(F.col(f"n{i}.tk") != F.col("tk"), F.col(f"n{i}.{value}") * (reach + 1 - k)).otherwise(0.0) for i, (_, k) in enumerate(ways)]
        return at.select("tk", sum(sums[1:], sums[0]).alias("s"))

    out = near(rows.withColumn("one", F.lit(1.0)), "one").groupBy(F.col("tk").alias("node")).agg(F.sum("s").alias("out"))
    move = lambda x: near(rows.join(x, rows["tk"] == x["node"]), "share").groupBy(F.col("tk").alias("v")).agg(F.sum("s").alias("m"))
    return _ranks(cut(out.where("out > 0")), move, damping, tolerance, most)


#: Words whose ranks are broadcast at most (8 bytes each, beside the words themselves while texts are coded), and tokens of a text that are taken at once.
RANKS, PLACES = 1 << 22, 1 << 20


def _around(ids: np.ndarray, doc: np.ndarray, value: np.ndarray, reach: int) -> np.ndarray:
    """For each word the weighted sum of ``value`` over the other words around all of its places."""
    out = np.zeros(len(value))
    for at in range(0, len(ids), PLACES):
        i, d = ids[at : at + PLACES + reach], doc[at : at + PLACES + reach]
        v, s = value[i], np.zeros(len(i))
        for k in range(1, min(reach, len(i) - 1) + 1):
            m = min(PLACES, len(i) - k)  # pairs whose first word is in this part
            w = (reach + 1 - k) * ((d[:m] == d[k : m + k]) & (i[:m] != i[k : m + k]))
            s[:m] += w * v[k : m + k]
            s[k : m + k] += w * v[:m]
        out += np.bincount(i, s, len(value))
    return out


def textrank_texts(docs: DataFrame, text: str = "text", reach: int = 4, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """``textrank`` of the words of ``docs(text)`` (texts or token arrays, see ``functions.words``), each row a text of its own.

    Texts are coded once as the numbers of their words. A round broadcasts the words' ranks, and a task adds what its places send, so that
    only a number a word leaves it. More words than ``RANKS`` are ranked by ``textrank``, which shuffles the places instead.
    """
    spark = docs.sparkSession
    words = cut(docs.select(text).mapInArrow(W.counts, "word string, n long").select("word").distinct())
    n_words = words.count()
    if n_words > RANKS:
        split = lambda batches: (pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), w)], ["t"]) for b in batches for w, n in W.words(b.column(0)))
        texts = docs.select(text).mapInArrow(split, "t array<string>").withColumn("doc_id", F.monotonically_increasing_id())
        return textrank(texts.select("doc_id", F.posexplode("t").alias("i", "tk")).where("tk is not null"), reach, damping, tolerance, most)
    names = words.orderBy("word").toArrow().column("word").cast(pa.string()).combine_chunks()
    names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) and names.num_chunks else pa.array(names.to_pylist(), pa.string())
    every = spark.sparkContext.broadcast(names)
    coded = cut(docs.select(text).mapInArrow(lambda batches: W.coded(batches, every.value), "ids array<int>"))

    def sums(value: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(shared.value))
            for batch in batches:
                col = batch.column(0)
                size = np.diff(np.asarray(col.offsets))
                out += _around(col.flatten().to_numpy(), np.repeat(np.arange(len(size), dtype=np.int32), size), shared.value, reach)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some])], ["word", "s"])

        got = coded.mapInArrow(run, "word int, s double").groupBy("word").agg(F.sum("s").alias("s")).toArrow()  # a number a word, of RANKS at most
        shared.unpersist()
        total = np.zeros(len(value))
        total[got.column("word").to_numpy()] = got.column("s").to_numpy()
        return total

    out = sums(np.ones(n_words)) if n_words else np.zeros(0)
    linked = out > 0
    n = max(int(linked.sum()), 1)
    ranks = np.where(linked, 1 / n, 0.0)
    for _ in range(most if linked.any() else 0):
        moved = sums(np.divide(ranks, out, out=np.zeros(n_words), where=linked))
        after = np.where(linked, (1 - damping) / n + damping * (1 - moved.sum()) / n + damping * moved, 0.0)
        gap, ranks = np.abs(after - ranks).sum(), after
        if gap < n * tolerance:
            break
    return spark.createDataFrame(pa.table({"node": names.filter(pa.array(linked)), "rank": ranks[linked]}), "node string, rank double")


def hits(edges: DataFrame, most: int = 1000, tolerance: float = 1e-12) -> DataFrame:
    """(node, hub, authority), each summing to 1: power iteration from all ones until no authority moves by more than ``tolerance``.

    On an undirected graph without a bipartite part the two agree. A graph without weight has zeros.
    """
    links = cut(both_ways(edges).groupBy("u", "v").agg(F.sum(F.col("w").cast("double")).alias("w")))
    pull = lambda x: links.join(x, links["v"] == x["node"]).groupBy(F.col("u").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    at = cut(links.select(F.col("u").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(most):
        # both half steps are one table, whose sum and rows are read from there, so the plan does not grow
        step = cut(pull(pull(at)).join(at.select("node", F.col("x").alias("was")), "node", "right").select("node", F.coalesce("x", F.lit(0.0)).alias("x"), "was"))
        total = step.agg(F.sum("x")).first()[0] or 0.0
        step = step.withColumn("x", F.col("x") / total if total > 0 else F.lit(0.0))
        at = step.select("node", "x")
        if total <= 0 or not (step.agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0) > tolerance:
            break
    hub = cut(pull(at))
    total = hub.agg(F.sum("x")).first()[0] or 0.0
    return at.join(hub.withColumnRenamed("x", "h"), "node", "left").select("node", (F.coalesce("h", F.lit(0.0)) / (total if total > 0 else 1.0)).alias("hub"), F.col("x").alias("authority"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by least-label propagation with label jumping."""
    links = cut(both_ways(edges.withColumn("w", F.lit(1))).select("u", "v").distinct())
    labels = cut(links.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = links.join(labels, links["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["node"] == near["u"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = low.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        after = cut(low.join(jump, low["component"] == jump["j"]).select("node", F.least("component", "jc").alias("component"), "was"))
        labels = after.select("node", "component")
        if after.where("component != was").isEmpty():
            return labels


def identity_components(same: DataFrame, different: DataFrame, preferred: DataFrame) -> DataFrame:
    """(node, representative) from ``same(a, b)``, ``different(a, b)`` and ``preferred(node)``.

    A component with a different-pair inside or more than one preferred member is not merged at all; else its
    representative is the preferred member or the smallest.
    """
    comp = components(same)
    x, y = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    blocked = different.join(x, "a").join(y, "b").where("ca = cb").select(F.col("ca").alias("component"))
    favoured = comp.join(preferred.distinct(), "node").groupBy("component").agg(F.min("node").alias("p"), F.count("*").alias("n"))
    blocked = blocked.union(favoured.where("n > 1").select("component")).distinct().withColumn("blocked", F.lit(True))
    out = comp.join(favoured.where("n = 1").select("component", "p"), "component", "left").join(blocked, "component", "left")
    return out.select("node", F.when(F.col("blocked"), F.col("node")).otherwise(F.coalesce("p", "component")).alias("representative"))


def acyclic(edges: DataFrame) -> bool:
    """Whether directed ``edges(a, b)`` have no cycle: nodes without incoming edges are stripped until none is left."""
    left = cut(edges.select("a", "b").distinct())
    while True:
        n = left.count()
        if not n:
            return True
        after = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        if after.count() == n:
            return False
        left = after
