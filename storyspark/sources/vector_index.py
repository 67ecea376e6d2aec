"""An inverted-file index of vectors for cosine search: lists by nearest centroid, written as partitions, of which a search reads the probed ones.

The centroids are fitted by spherical k-means on a sample of at most ``SAMPLE`` vectors (those of least id hash, so the
sample does not change between runs); every vector is indexed. A list of any size is dealt over several tasks when it is
written and is read in file splits when it is searched, so a list that holds a third of all vectors is no single task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, lists at most, and rounds of k-means.
SAMPLE, LISTS, ROUNDS = 1 << 16, 4096, 12
#: Share of the nearest vectors that a search finds, on the sample; it sets how many lists are probed.
RECALL = 0.97
#: Bytes of queries (with their probes) that are broadcast at once; more queries take several passes over the index.
QUERY_BYTES = 64 << 20
#: Vectors of more components than this are kept in half precision.
HALF_ABOVE = 2000
#: Rows of one list that a task writes into one file, about.
FILE_ROWS = 1 << 20


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column (float64); rows that are null, of another length, zero or not finite are all 0."""
    out = np.zeros((len(col), dim))
    size = np.array([len(x) if x is not None else -1 for x in col.to_pylist()]) if col.null_count else np.diff(np.asarray(col.offsets))
    ok = np.flatnonzero(size == dim)
    if len(ok):
        flat = col.take(pa.array(ok)).flatten()
        out[ok] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(ok), dim)
    out[~np.isfinite(out).all(1)] = 0
    # scaled before squares, so that tiny and huge vectors keep their direction
    top = np.abs(out).max(1, keepdims=True, initial=0)
    out /= np.where(top > 0, top, 1)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``k`` unit centroids of unit rows; an empty one restarts at the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        near = x @ centre.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    return centre


def probes_needed(x: np.ndarray, centre: np.ndarray, k: int = 10, recall: float = RECALL, queries: int = 256) -> int:
    """How many lists a search must probe for ``recall``: by the list, in order of nearness, of each of the ``k`` nearest in the sample."""
    ask = x[:queries]
    near = ask @ x.T
    near[np.arange(len(ask)), np.arange(len(ask))] = -np.inf
    best = np.argsort(-near, 1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    place = np.argsort(np.argsort(-(ask @ centre.T), 1, kind="stable"), 1)
    home = (x @ centre.T).argmax(1)
    return int(np.quantile(place[np.arange(len(ask))[:, None], home[best]], recall, method="higher")) + 1


def fit_centroids(vectors: DataFrame, dim: int, lists: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Centroids of ``vectors(id, vector)``, as many as the root of the row count says, ``LISTS`` at most; and the lists to probe."""
    n = vectors.count()
    rows = vectors.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector")
    x = _matrix(rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows, dim)
    x = x[np.abs(x).sum(1) > 0]
    k = min(lists or max(1, min(LISTS, math.isqrt(n))), len(x))
    centre = spherical_kmeans(x, k) if k else np.zeros((0, dim))
    return centre, probes_needed(x, centre) if k else 1


def build(vectors: DataFrame, path: str, dim: int, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write an index of ``vectors(id, vector)`` to ``path``: ``lists`` (id, vector, partitioned by list) and ``centroids``.

    Partial, per dimension: vectors of another length than ``dim`` are not in it, nor are null, zero and non-finite ones,
    which have no direction, and rows without an id. Repeated ids are kept each. An empty table gives an index without lists.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("id").cast("long").alias("id"), "vector").where("id is not null")
    centre, probes = fit_centroids(vectors, dim, lists, sample)
    shared = spark.sparkContext.broadcast(centre)
    kind = "float" if dim <= HALF_ABOVE else "binary"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), dim)
                real = np.flatnonzero(np.abs(x).sum(1) > 0)
                if not len(real) or not len(c):
                    continue
                x = x[real]
                own = (x @ c.T).argmax(1).astype(np.int32)
                kept = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32())) if kind == "float" else pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(real)), kept, pa.array(own)], ["id", "vector", "list"])

    placed = vectors.mapInArrow(assign, f"id long, vector {'array<float>' if kind == 'float' else 'binary'}, list int")
    # a list goes to as many tasks as its share of the rows needs: the salt is of the id, so a hot list is split too
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, min(64, spark.sparkContext.defaultParallelism))))
    placed.repartition(F.col("list"), salt).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{path}/lists")
    told = [(i, [float(v) for v in c]) for i, c in enumerate(centre)]
    spark.createDataFrame(told, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(json.dumps({"dim": dim, "kind": kind, "probes": probes}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def probed(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """The index rows of some lists; the filter is on the partition column, so no other list is read."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    schema = f"id long, vector {'array<float>' if about['kind'] == 'float' else 'binary'}, list int"
    return spark.read.schema(schema).parquet(f"{path}/lists").where(F.col("list").isin(lists) if lists else F.lit(False))


def search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, least: float = -1.0) -> DataFrame:
    """(qid, id, cosine, place): for each of ``queries(qid, vector)`` the ``k`` nearest vectors of its ``probes`` nearest lists
    (without that, as many as gave ``RECALL`` on the sample when the index was built).

    Cosines under ``least`` go; equal cosines stand by id. An indexed vector of the query's own id is not its result. A query
    without direction, or of another dimension than the index, has none. Each task keeps the ``k`` best of every query, and only those are shuffled.
    """
    spark = queries.sparkSession
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    dim, half, probes = about["dim"], about["kind"] == "binary", probes or about["probes"]
    stored = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow().column("centroid").to_pylist()  # LISTS at most
    centre = np.array(stored) if stored else np.zeros((0, dim))
    queries = queries.select(F.col("qid").cast("long").alias("qid"), "vector").where("qid is not null and vector is not null")
    block = max(1, QUERY_BYTES // (8 * dim))
    blocks = -(-queries.count() // block)
    out = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow().combine_chunks()
        rows = some.to_batches()
        ids = np.concatenate([np.asarray(r.column(0)) for r in rows]) if rows else np.zeros(0, np.int64)
        q = np.concatenate([_matrix(r.column(1), dim) for r in rows]) if rows else np.zeros((0, dim))
        real = np.abs(q).sum(1) > 0
        ids, q = ids[real], q[real]
        near = np.argsort(-(q @ centre.T), 1, kind="stable")[:, :probes] if len(centre) and len(q) else np.zeros((len(q), 0), int)
        asks: dict[int, np.ndarray] = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((ids, q, asks))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asks = shared.value
            top_s, top_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    own, lists = np.asarray(part.column(0)), np.asarray(part.column(2))
                    if half:
                        x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float16).astype(np.float64).reshape(-1, dim)
                    else:
                        x = np.asarray(part.column(1).flatten()).astype(np.float64).reshape(-1, dim)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    for c in np.unique(lists):
                        ask, rows = asks.get(int(c)), np.flatnonzero(lists == c)
                        if ask is None:
                            continue
                        s = q[ask] @ x[rows].T
                        s[ids[ask][:, None] == own[rows][None]] = -np.inf
                        s[s < least] = -np.inf
                        s = np.concatenate([top_s[ask], s], 1)
                        i = np.concatenate([top_i[ask], np.broadcast_to(own[rows], (len(ask), len(rows)))], 1)
                        order = np.lexsort((i, -s), axis=1)[:, :k]
                        top_s[ask], top_i[ask] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            has = np.isfinite(top_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(len(ids), k)[has]), pa.array(top_i[has]), pa.array(top_s[has])], ["qid", "id", "cosine"])

        part = probed(spark, path, sorted(asks)).mapInArrow(best, "qid long, id long, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, cosine double, place int")
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
