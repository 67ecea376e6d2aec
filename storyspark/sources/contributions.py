"""Writes of facts with a replay check: dimensions are got or created, facts appended once per producer, a replay must bring the same.

A producer's contribution is known by a fingerprint that does not depend on the order of its rows. A second write of the same
contribution appends nothing; one that differs is an error, before anything is written. Facts go to a partition of their
producer and the fingerprint is written last, so a write that failed half-way is written over by the next attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.operators.graph_algorithms import cut


def stable_id(*parts: Column) -> Column:
    """An id that depends on its parts alone: the first 32 digits of SHA-256 of their canonical JSON (a null is null, not empty)."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}).cast("binary"), 256), 1, 32)


def fingerprint(facts: DataFrame, key: str = "producer") -> DataFrame:
    """(producer, n, total, mixed) of each producer's rows: count, sum and exclusive or of their hashes, whatever their order.

    Two hashes of different seeds go in, so that equal rows do not cancel out and a chance match would have to be twofold.
    """
    columns = sorted(c for c in facts.columns if c != key)
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    h = F.xxhash64(row)
    other = F.xxhash64(F.lit("second"), row)
    return facts.groupBy(key).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(other).alias("mixed"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], like.schema)


def get_or_create(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The dimension rows of ``wanted(keys...)``: those that the table at ``path`` lacks are appended, under ids that depend on the keys alone.

    A second writer of the same key makes the same id, so a repeated row would be equal and is taken once.
    """
    rows = wanted.select(*keys).distinct().withColumn(name, stable_id(*[F.col(k) for k in keys]))
    have = _table(spark, path, rows).select(name).distinct()
    rows.join(have, name, "left_anti").write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).distinct().join(rows.select(name), name, "left_semi")


def contribute(facts: DataFrame, path: str, dimensions: dict[str, list[str]] | None = None) -> DataFrame:
    """Append the contributions of ``facts(producer, ...)`` to the tables under ``path``; (producer, rows, appended) of each.

    ``dimensions`` names tables and their key columns: each is got or created and its key columns give way to the id ``<name>_id``. A
    known producer whose rows, stored or submitted, differ from what it first wrote is an error, and then nothing is written. Equal rows
    within one contribution count each. An empty table changes nothing.
    """
    spark = facts.sparkSession
    told = facts
    for name, keys in (dimensions or {}).items():
        told = told.withColumn(f"{name}_id", F.when(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull(), stable_id(*[F.col(k) for k in keys]))).drop(*keys)
    marks = fingerprint(told)
    known = _table(spark, f"{path}/contributions", marks)
    both = marks.alias("m").join(known.alias("k"), "producer", "left")
    same = F.col("m.n").eqNullSafe(F.col("k.n")) & F.col("m.total").eqNullSafe(F.col("k.total")) & F.col("m.mixed").eqNullSafe(F.col("k.mixed"))
    # a table, as it is read again after the tables that it was made from have grown
    state = cut(both.select("producer", F.col("m.n").alias("rows"), F.col("k.n").isNull().alias("new"), same.alias("same")))
    if not state.where("not new and not same").isEmpty():
        raise ValueError("a producer's contribution differs from the one it wrote before")
    old = state.where("not new").select("producer")
    if not old.isEmpty():
        stored = spark.read.schema(told.schema).parquet(f"{path}/facts").join(old, "producer", "left_semi")
        clash = fingerprint(stored).alias("s").join(known.alias("k"), "producer").where("s.n <> k.n or s.total <> k.total or s.mixed <> k.mixed")
        lost = old.join(stored.select("producer").distinct(), "producer", "left_anti")
        if not (clash.isEmpty() and lost.isEmpty()):
            raise ValueError("stored facts are not those that were contributed")
    fresh = state.where("new").select("producer")
    for name, keys in (dimensions or {}).items():
        present = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
        get_or_create(spark, f"{path}/{name}", facts.join(fresh, "producer", "left_semi").where(present), keys, f"{name}_id")
    told.join(fresh, "producer", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("producer").parquet(f"{path}/facts")
    marks.join(fresh, "producer", "left_semi").write.mode("append").parquet(f"{path}/contributions")
    return state.select("producer", "rows", F.col("new").alias("appended"))
