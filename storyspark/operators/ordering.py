"""Global order without a global window: numbers and running sums over a whole table, by range partitions and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.operators.graph_algorithms import cut


def running(df: DataFrame, order: list[Column], name: str, amount: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` (of 1 without it: the row's number from 1) over all rows up to each in ``order``.

    The order must be total. Rows are dealt by ranges of the order, each range is summed by itself, and the sums of the ranges
    before it, one number a partition, are added. An empty table stays empty; null amounts count as 0.
    """
    spark = df.sparkSession
    amount = F.lit(1) if amount is None else amount
    parts = df.withColumn("_amount", F.coalesce(amount, F.lit(0))).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)  # where the ranges lie is drawn from a sample: they are fixed once
    sums = parts.groupBy("_part").agg(F.sum("_amount").alias("n"))
    kind = sums.schema["n"].dataType.simpleString()
    before, offsets = None, []
    for row in sums.orderBy("_part").collect():  # a row for each partition
        offsets.append((row["_part"], before))
        before = row["n"] if before is None else before + row["n"]
    offsets = spark.createDataFrame(offsets, f"_part int, _before {kind}")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(offsets), "_part").withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum("_amount").over(within))
    return out.drop("_part", "_before", "_amount")


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with each row's number, from 1, in a total order."""
    return running(df, order, name).withColumn(name, F.col(name).cast("long"))
