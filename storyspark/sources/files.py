"""Sources and sinks: texts with an encoding ladder, metadata, lexicons, vectors; partition overwrite, upsert, insert-ignore, validated writes, JSON export."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.functions import cjk


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of a file or of a folder's ``*.txt`` files, each decoded by the first encoding that fits; none is an error."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(cjk.decode)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", decoded("content").alias("text"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """title, author and genre of a JSON object; blanks are null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "title string, author string, genre string").alias("m")).select("m.*")
    return raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, ord): one term a line, comments and columns after a tab left out, repeated terms at their first line."""
    term = F.trim(F.split(F.regexp_replace("line", r"^#.*|\s+#.*$", ""), "\t")[0])
    rows = _numbered(spark, path).select("line_no", term.alias("term")).where("term <> ''")
    return rows.groupBy("term").agg(F.min("line_no").alias("ord"))


def read_sectioned_lexicon(spark: SparkSession, path: str, sections: dict[str, str]) -> DataFrame:
    """(category, term, ord): lines under headers ``# ===== n. title =====`` get the category that the title maps to; others go."""
    mapping = F.create_map(*[F.lit(x) for kv in sections.items() for x in kv])
    rows = _numbered(spark, path).withColumn("header", F.nullif(F.regexp_extract("line", r"^#\s*=+\s*(?:\d+\.\s*)?(.*?)\s*=+\s*$", 1), F.lit("")))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # one file's lines
    rows = rows.withColumn("category", mapping[F.last("header", ignorenulls=True).over(w)])
    return rows.where("category is not null and line not like '#%' and trim(line) <> ''").groupBy("category", F.trim("line").alias("term")).agg(F.min("line_no").alias("ord"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text vector file with a ``count dimension`` header; a line of another length is an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+$"))
    parts = F.split(F.trim("value"), " ")
    return lines.select(parts[0].alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("float")).alias("vector"))


def overwrite_runs(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the written partitions (run, or run and feature code) and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(partitions or ("run_id",))).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys are not in it; a known key with other content is an error."""
    values = [c for c in new.columns if c not in keys]
    clash = new.alias("n").join(old.alias("o"), keys).where(~F.struct(*[f"n.{c}" for c in values]).eqNullSafe(F.struct(*[f"o.{c}" for c in values])))
    if values and not clash.isEmpty():
        raise ValueError("a repeated key has different content")
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def validated_topics(rows: DataFrame, k: int) -> DataFrame:
    """``rows(paragraph_id, topic_id, topic_weight)`` if every paragraph has the topics 0..k-1 once, with finite weights >= 0 that sum to 1; else an error."""
    per = rows.groupBy("paragraph_id").agg(F.count("*").alias("n"), F.countDistinct("topic_id").alias("d"), F.min("topic_id").alias("lo"), F.max("topic_id").alias("hi"), F.sum("topic_weight").alias("s"), F.min("topic_weight").alias("least"))
    ok = (F.col("n") == k) & (F.col("d") == k) & (F.col("lo") == 0) & (F.col("hi") == k - 1) & (F.abs(F.col("s") - 1) <= 1e-5) & (F.col("least") >= 0)
    if not per.where(~F.coalesce(ok, F.lit(False))).isEmpty():
        raise ValueError("topic rows are incomplete")
    return rows


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` if its columns and types are those of ``schema``; else an error."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in schema]
    if have != want:
        raise ValueError(f"schema mismatch: {have} is not {want}")
    return df


def export_json(tables: dict[str, DataFrame], key: Column, path: str) -> None:
    """One JSON document a key: every table's rows as an array; keys missing from a table are left out of its document."""
    out = None
    for name, df in tables.items():
        part = df.groupBy(key.alias("key")).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = part if out is None else out.join(part, "key", "full_outer")
    out.select(F.to_json(F.struct(*out.columns)).alias("value")).write.mode("overwrite").text(path)
