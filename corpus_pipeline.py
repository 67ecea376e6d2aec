"""The corpus pipeline: documents to packed training sequences.

Stages, in order: language identification (documents without a language go), line dedup (passages repeated from earlier
documents go, and documents that consist of nothing else), n-gram Jaccard join (one document of each near-duplicate group stays), benchmark
decontamination (documents with a benchmark passage go), best-fit packing. Every stage takes the columns of
``documents`` and all but the last return them. Each works on the whole output of the stage before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm.common import materialize
from storyspark.llm.decontaminate import decontaminate
from storyspark.llm.language_id import UNDETERMINED, identify
from storyspark.llm.line_dedup import dedup_lines
from storyspark.llm.ngram_join import keep_one
from storyspark.llm.packing import pack

#: Near duplicates of the pipeline: five-word shingles, Jaccard similarity of 80 / 100 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Parts of the key space that the join counts one after the other (a lower similarity has more keys).
ROUNDS = 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one. Texts that are null or have no letters go."""
    return identify(docs).where(F.col("lang_pred") != UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold; one that thereby loses its last word goes."""
    return dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return keep_one(docs, SHINGLE_WORDS, SIMILARITY, ROUNDS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", near_duplicate_stage), ("benchmark_decontamination", benchmark_stage), ("best_fit_packing", packing_stage)]

#: SQL cannot express the trained and aligned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
