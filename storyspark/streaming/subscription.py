"""A durable consumer of the notification log, and subscriptions that get a snapshot and then exactly what comes after it.

Each micro-batch is written under its number: first its new messages, then the state of the runs it touched, then a mark. A
batch that failed half-way is written over when the stream restarts, and readers see only marked batches, so nothing is
lost, repeated or half visible. A message whose key is known does not count again; with other content it is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyspark.streaming.outbox import folded

LOG = "run_id long, seq long, message_key string, text string, batch long"
STATE = "run_id long, last_seq long, messages long, tail string, batch long"


def _marks(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole batches, in order (names of folders only)."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/mark")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if "=" in s.getPath().getName()) if fs.exists(at) else []


def _upto(spark: SparkSession, folder: str, part: str, schema: str, last: int | None, first: int = 0) -> DataFrame:
    """Rows of the marked batches ``first`` to ``last``; the filter is on the partition column."""
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{part}").where(F.col("batch").between(first, last))


def states(spark: SparkSession, folder: str, last: int | None) -> DataFrame:
    """Each run's state after batch ``last``: the newest of the states that the batches wrote."""
    rows = _upto(spark, folder, "state", STATE, last)
    newest = Window.partitionBy("run_id").orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("run_id", "last_seq", "messages", "tail")


def store(df: DataFrame, number: int, folder: str) -> None:
    """Write batch ``number`` of (run_id, seq, message_key, text) whole, whatever an earlier attempt at it has left."""
    spark = df.sparkSession
    before = [m for m in _marks(spark, folder) if m < number]
    last = before[-1] if before else None
    keys = ["run_id", "message_key"]
    once = df.groupBy(*keys).agg(F.min("seq").alias("seq"), F.min("text").alias("text"), F.count_distinct(F.coalesce("text", F.lit(""))).alias("texts"))
    known = _upto(spark, folder, "log", LOG, last).select(*keys, F.col("text").alias("had"), F.lit(True).alias("known"))
    met = once.join(known, keys, "left").select(*keys, "seq", "text", "known", (~F.col("text").eqNullSafe(F.col("had")) & F.col("known") | (F.col("texts") > 1)).alias("clash")).persist()
    try:
        if not met.where("clash").isEmpty():
            raise ValueError("a message key was sent with different content")
        new = met.where("known is null").select("run_id", "seq", "message_key", "text")
        new.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        new = spark.read.schema(new.schema).parquet(f"{folder}/log/batch={number}")
        folded(states(spark, folder, last), new.select("run_id", "seq", "text")).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/mark/batch={number}")
    finally:
        met.unpersist()


def consume(messages: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start the consumer of streaming ``messages(run_id, seq, message_key, text)``; a restart goes on where the last one stopped."""
    write = messages.select("run_id", "seq", "message_key", "text").writeStream.option("checkpointLocation", f"{folder}/progress")
    return write.foreachBatch(lambda df, number: store(df, number, folder)).trigger(**(trigger or {"availableNow": True})).start()


def connect(spark: SparkSession, folder: str, at: int | None = None) -> tuple[DataFrame, int | None]:
    """(snapshot, cut): the state of every run after the newest whole batch (or after ``at``), and the batch at which it was cut."""
    marks = [m for m in _marks(spark, folder) if at is None or m <= at]
    last = marks[-1] if marks else None
    return states(spark, folder, last), last


def deltas(spark: SparkSession, folder: str, cut: int | None) -> DataFrame:
    """The messages after a snapshot that was cut at batch ``cut``: of later whole batches, past each run's cursor, in (run_id, seq)."""
    marks = _marks(spark, folder)
    if not marks:
        return spark.createDataFrame([], LOG).drop("batch")
    later = _upto(spark, folder, "log", LOG, marks[-1], -1 if cut is None else cut + 1)
    cursor = states(spark, folder, cut).select("run_id", F.col("last_seq").alias("cursor"))
    return later.join(cursor, "run_id", "left").where(F.col("cursor").isNull() | (F.col("seq") > F.col("cursor"))).select("run_id", "seq", "message_key", "text")
