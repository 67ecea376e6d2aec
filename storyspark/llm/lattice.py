"""Embedding near-duplicates by E8 lattice hashing.

A unit vector is projected to blocks of eight dimensions; each scaled block is decoded to the nearest point of the E8
lattice, and the points of a table's blocks are its cell. A vector is stored in its own cell of every table and looks also
into the cells got by moving one block to its nearest neighbouring lattice points. Pairs that meet are verified by cosine
in double precision. The projections are fixed by a seed; nothing is fitted. Vectors equal in all components (and label)
are one class, so that large groups of copies cost one vector.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import materialize, table
from storyspark.llm.components import components

TABLES, BLOCKS, PROBES = 6, 2, 2
#: Lattice scale in units of the distance, in one block's space, of two unit vectors at the threshold.
SCALE = 3.0
COSINE = 0.98
_PAIRS = [np.array([s if i == a else t if i == b else 0 for i in range(8)], float) for a, b in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
_HALVES = [np.array(s, float) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
#: The 240 shortest vectors of E8.
NEIGHBOURS = np.array(_PAIRS + _HALVES)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    if len(odd):
        error = x[odd] - near[odd]
        worst = np.abs(error).argmax(1)
        near[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: integer coordinates of even sum, or the same moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _projections(dim: int, tables: int, blocks: int) -> np.ndarray:
    out = []
    for t in range(tables):
        g = np.random.default_rng(1000 + t).normal(size=(dim, max(8 * blocks, 8)))
        q = np.linalg.qr(g)[0] if dim >= 8 * blocks else g / np.sqrt(dim)
        out.append(q[:, : 8 * blocks])
    return np.array(out)


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, cosine: float = COSINE) -> np.ndarray:
    """Cell hashes (vector, table, 1 + blocks * probes): each vector's own cell first, then neighbours."""
    n, dim = unit.shape
    width = SCALE * np.sqrt(2 - 2 * cosine) * np.sqrt(min(1.0, 8 / dim))
    out = np.zeros((n, tables, 1 + blocks * probes), np.uint64)
    mult = K.mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    for t, proj in enumerate(_projections(dim, tables, blocks)):
        parts, moved = [], []
        for b in range(blocks):
            x = unit @ proj[:, 8 * b : 8 * b + 8] / width
            p = nearest(x)
            gain = (x - p) @ NEIGHBOURS.T
            best = np.argpartition(-gain, probes, axis=1)[:, :probes]
            salt = np.uint64(K.mix_int(t * 64 + b + 1))
            hashed = lambda q, salt=salt: K.mix((np.rint(2 * q).astype(np.int64).astype(np.uint64) * mult).sum(-1) + salt)
            parts.append(hashed(p))
            moved.append(hashed(p[:, None, :] + NEIGHBOURS[best]))
        base = np.add.reduce(parts)
        out[:, t, 0] = base
        for b in range(blocks):
            out[:, t, 1 + b * probes : 1 + (b + 1) * probes] = (base - parts[b])[:, None] + moved[b]
    return K.mix(out)


def _index(classes: DataFrame, cosine: float) -> DataFrame:
    """(cell, cid, home) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            vectors = batch.column(2)
            dims = np.diff(np.frombuffer(vectors.buffers()[1], np.int32, len(vectors) + 1, vectors.offset * 4)) if len(vectors) else np.zeros(0, int)
            for dim in np.unique(dims):
                for at in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // 512)):
                    v = np.array(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), dim)
                    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
                    v = v / np.linalg.norm(v, axis=1, keepdims=True)
                    c = cells(v, cosine=cosine)
                    c = K.mix(c + (K.mix(label[at].astype(np.int64).astype(np.uint64)) + np.uint64(dim))[:, None, None])
                    home = np.zeros(c.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(c.ravel().view(np.int64)), pa.array(np.repeat(cid[at], c[0].size)), pa.array(home.ravel())], ["cell", "cid", "home"])

    return classes.select("cid", "label", "embedding").mapInArrow(run, "cell long, cid long, home boolean")


def _verify(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    left = vectors.select(F.col("cid").alias("a"), F.col("embedding").alias("va"), F.col("label").alias("la"))
    right = vectors.select(F.col("cid").alias("b"), F.col("embedding").alias("vb"), F.col("label").alias("lb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x, y = (np.array(part.column(i).flatten().to_numpy(zero_copy_only=False), float) for i in (2, 3))
                n = np.array(part.column(4), np.int64)
                group, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                x, y = (v / np.maximum.reduceat(np.abs(v), first)[group] for v in (x, y))  # squares neither vanish nor overflow
                dot, xx, yy = (np.bincount(group, p, len(n)) for p in (x * y, x * x, y * y))
                keep[lo : lo + len(n)] = dot >= cosine * np.sqrt(xx) * np.sqrt(yy)
            yield batch.select([0, 1]).filter(pa.array(keep))

    both = pairs.join(left, "a").join(right, "b").where("la = lb and size(va) = size(vb)")
    return both.select("a", "b", "va", "vb", F.size("va").alias("n")).mapInArrow(run, "a long, b long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``embeddings(vec_id, embedding, label)``: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal dimension link when found with cosine >= ``cosine``. Vectors that are null, zero or
    empty, or hold null or non-finite components, and rows without label, link with nothing and are kept (a row without id never is). Rows that repeat
    a vector (even with its id) are vectors of their own and link with each other. component_id is the smallest vec_id
    reachable, null ids aside; kept tells whether that is the row's own. An empty table gives an empty one; of other columns none is read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("embedding", F.when(F.col("fine"), F.transform("embedding", lambda x: x + 0.0)))
    classes = materialize(rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    index = materialize(_index(classes, cosine))
    home = index.where("home").select("cell", F.col("cid").alias("x"))
    pairs = home.join(index.select("cell", F.col("cid").alias("y")), "cell").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = materialize(_verify(pairs, classes.select("cid", "label", "embedding"), cosine))
    reach = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    both = links.union(links.select("b", "a")).toDF("cid", "other")
    sizes = classes.select(F.col("cid").alias("other"), F.col("n").alias("m"))
    degree = materialize(both.join(sizes, "other").groupBy("cid").agg(F.sum("m").alias("d")))
    info = classes.join(degree, "cid", "left").join(reach, classes["cid"] == reach["node"], "left")
    info = materialize(info.select("label", "embedding", "rep", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("c")))
    least = info.groupBy("c").agg(F.min("rep").alias("component_id"))
    info = materialize(info.join(least, "c").select("label", "embedding", "n_links", "component_id"))
    out = rows.join(info, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
