"""Shared plumbing of the training-data operators: durable intermediate tables, clean column sets, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (a longer single text is one block of its own).
BLOCK_BYTES = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine, where that is unset (tests), a fresh temporary folder is set."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="storyspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._storyspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads."""
    for df in frames:
        path = getattr(df, "_storyspark_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (its result replaces them)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch whose text column holds about ``limit`` bytes, one row at least and ``rows`` at most; order is kept."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    import numpy as np

    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, len(col), at + rows)
        yield batch.slice(at, end - at)
        at = end


#: Bits of the table that tells which keys are shared (a set bit may be chance; the key is then looked at in vain).
KNOWN_BITS = 1 << 27


def known_keys(lists: DataFrame, key: str):
    """Broadcast bit table of ``KNOWN_BITS`` bits, of constant size, with a bit set for every value of ``lists[key]``."""
    import numpy as np

    bit = F.col(key).bitwiseAND(F.lit(KNOWN_BITS - 1))
    words = lists.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(KNOWN_BITS >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return lists.sparkSession.sparkContext.broadcast(out)


def is_known(table, keys):
    """Which of an array of unsigned 64-bit keys have their bit set in the broadcast ``table``."""
    import numpy as np

    bit = keys & np.uint64(KNOWN_BITS - 1)
    return (table.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def crc_fold(column: str, parts: int) -> F.Column:
    """crc32 of the id written as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
