"""Topic models, word vectors and linear fits on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from storyspark.functions import words
from storyspark.operators.graph_algorithms import cut


def topic_count(k: int | None, documents: int, least: int = 3, most: int = 25, divisor: int = 30) -> int:
    """``k``, or where it is null the document count over ``divisor`` within bounds."""
    return k if k is not None else max(least, min(most, documents // divisor))


def dictionary(docs: DataFrame, tokens: str = "tokens", vocabulary: int = 1 << 18) -> CountVectorizerModel:
    """Vectoriser of the ``vocabulary`` most frequent words of ``docs``, ties by the word; their places do not tell their ranks.

    ``tokens`` are token arrays, or texts that are split as ``functions.words`` does. Spark ML's own fit makes objects of all tokens; here
    tasks count the words of many documents at once, and the vectoriser is fitted on the chosen words alone (in one task, as their number is bounded).
    """
    counts = docs.select(tokens).mapInArrow(words.counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = counts.orderBy(F.desc("n"), "word").limit(vocabulary).select(F.array("word").alias(tokens)).coalesce(1)
    return CountVectorizer(inputCol=tokens, outputCol="bow", minDF=1.0, vocabSize=vocabulary).fit(chosen)


def bags(docs: DataFrame, vectoriser: CountVectorizerModel, tokens: str = "tokens") -> DataFrame:
    """``docs`` with the number of their tokens (``n_all``), of those in the dictionary (``n_tokens``) and the bag of these (``bow``)."""
    known = docs.sparkSession.sparkContext.broadcast(vectoriser.vocabulary)  # of a bounded size

    @F.arrow_udf(StructType([StructField("n_all", LongType()), StructField("n_tokens", LongType()), StructField("bow", VectorUDT())]))
    def bag(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = pa.array(known.value, pa.string())
        for col in cols:
            yield words.bags(col, vocabulary)

    return docs.withColumn("bag", bag(tokens)).withColumns({c: F.col(f"bag.{c}") for c in ("n_all", "n_tokens", "bow")}).drop("bag")


def fit_bags(docs: DataFrame, k: int = 25, iterations: int = 10, seed: int = 42):
    """LDA model of ``bags`` with at least one token; it reads them several times, so they should be a table (``cut``)."""
    return LDA(k=k, maxIter=iterations, optimizer="online", optimizeDocConcentration=True, seed=seed, featuresCol="bow").fit(docs.where("n_all > 0"))


def infer_bags(docs: DataFrame, model) -> DataFrame:
    """``bags`` with status, in-dictionary token count and dense topic weights (zero where nothing is in the dictionary)."""
    status = F.when(F.col("n_all") == 0, "empty").when(F.col("n_tokens") == 0, "out_of_vocabulary").otherwise("ok")
    weights = F.when(F.col("n_tokens") > 0, vector_to_array("topicDistribution")).otherwise(F.array_repeat(F.lit(0.0), model.getK()))
    return model.transform(docs).withColumn("status", status).withColumn("weights", weights).drop("n_all", "bow", "topicDistribution")


def fit_lda(docs: DataFrame, tokens: str = "tokens", k: int = 25, iterations: int = 10, vocabulary: int = 1 << 18, seed: int = 42):
    """(vectoriser, LDA model) of ``docs`` with at least one token (token arrays or texts, see ``dictionary``)."""
    vectoriser = dictionary(docs, tokens, vocabulary)
    return vectoriser, fit_bags(cut(bags(docs.select(tokens), vectoriser, tokens).drop(tokens)), k, iterations, seed)


def infer_lda(docs: DataFrame, vectoriser, model, tokens: str = "tokens") -> DataFrame:
    """``docs`` with status, in-dictionary token count and dense topic weights (zero where nothing is in the dictionary)."""
    return infer_bags(bags(docs, vectoriser, tokens), model)


@dataclass
class TopicModel:
    """A saved topic model; where it cannot be had, ``reason`` says why and the rest is null."""

    words: CountVectorizerModel | None = None
    model: LocalLDAModel | None = None
    labels: dict[int, str] = field(default_factory=dict)
    reason: str | None = None


def save_topic_model(spark: SparkSession, path: str, words: CountVectorizerModel, model, labels: dict[int, str] | None = None) -> None:
    """Write a topic model with its dictionary and labels to a shared folder; the labels come last, so a folder without them is not whole."""
    words.write().overwrite().save(f"{path}/words")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(int(k), v) for k, v in (labels or {}).items()], "topic int, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


def load_topic_model(spark: SparkSession, path: str) -> TopicModel:
    """The model under ``path``: missing folders and broken files are a reason, not an exception."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    try:
        for part in ("", "/words", "/model", "/labels"):
            if not fs(path + part):
                return TopicModel(reason=f"topic_model_artifact_missing: {path}{part}")
        words, model = CountVectorizerModel.load(f"{path}/words"), LocalLDAModel.load(f"{path}/model")
        labels = {r["topic"]: r["label"] for r in spark.read.schema("topic int, label string").parquet(f"{path}/labels").collect()}  # as many as topics
    except Exception as e:  # the readers raise whatever a broken file makes them meet; the reason keeps it
        return TopicModel(reason=f"topic_model_load_failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
    if model.vocabSize() != len(words.vocabulary):
        return TopicModel(reason=f"topic_model_load_failed: {model.vocabSize()} words in the model, {len(words.vocabulary)} in its dictionary")
    return TopicModel(words, model, labels)


def topic_words(words, model, n: int = 10) -> DataFrame:
    """(topic, place, word, weight)."""
    vocab = words_table(model.describeTopics(1).sparkSession, words.vocabulary)
    rows = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    return rows.join(vocab, F.col("t.termIndices") == F.col("i")).select("topic", "place", "word", F.col("t.termWeights").alias("weight"))


def words_table(spark: SparkSession, words: list[str]) -> DataFrame:
    """(i, word) of a dictionary, whose size is bounded."""
    return spark.createDataFrame(pd.DataFrame({"i": range(len(words)), "word": words}), "i int, word string")


#: Tokens that a task of Word2Vec learns from.
TASK_TOKENS = 1 << 22


def fit_word2vec(docs: DataFrame, tokens: str = "tokens", size: int = 50, window: int = 5, min_count: int = 2, seed: int = 42) -> DataFrame:
    """(word, vector); trained from scratch (Spark ML has no warm start).

    Spark ML trains in one task unless told otherwise: here a task has some ``TASK_TOKENS`` tokens, and what the tasks learnt is averaged.
    """
    n = docs.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("long"))).first()[0] or 0
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, numPartitions=max(1, -(-n // TASK_TOKENS)), inputCol=tokens, outputCol="v").fit(docs.where(F.col(tokens).isNotNull()))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def ridge(rows: DataFrame, features: str, target: str, penalty: float = 1.0):
    """Ridge fit on centred data (coefficients, intercept); null with fewer than two rows or a constant target."""
    stats = rows.agg(F.count("*").alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if stats["n"] < 2 or stats["lo"] == stats["hi"]:
        return None
    fit = LinearRegression(featuresCol="f", labelCol="y", regParam=penalty / stats["n"], elasticNetParam=0.0, standardization=False, solver="normal").fit(rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("f"), F.col(target).cast("double").alias("y")))
    return list(fit.coefficients), fit.intercept
