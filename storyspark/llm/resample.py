"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features are hashed into buckets; a bucket's gain is the log ratio of its shares in the target texts and in the corpus. A
document is scored without an explode: higher-order functions turn its text into an array of buckets, and ``aggregate``
sums over it the elements of one literal array with the gain of every bucket. Only the totals of the buckets (partial sums
of ``BUCKETS`` keys a task) are shuffled for the model. Gumbel noise from a hash of the id turns the weights into a draw
without replacement: the best scores are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import materialize, table, without
from storyspark.operators import ordering

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] before lower-casing, so that words are found in the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
COLUMNS = ("n_features", "weight", "score", "rank")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (null: none)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    # lower() has a fast way for ASCII words and would fold other letters too
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def buckets(text: Column, orders: tuple[int, ...] = (1,), n: int = BUCKETS) -> Column:
    """The bucket of every feature: runs of as many successive words as ``orders`` says, joined by one space."""
    bucket = lambda s: (F.crc32(s.cast("binary")) % n).cast("int")
    if orders == (1,):
        return F.transform(words(text), bucket)
    # one array of words, bound to a variable: a run of k words starts at each of the first size - k + 1
    run = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: bucket(F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.flatten(F.transform(F.array(words(text)), lambda w: F.array(*[run(w, k) for k in orders]))))


def totals(texts: DataFrame, orders: tuple[int, ...] = (1,), n: int = BUCKETS) -> list[int]:
    """How many features of all rows of ``texts(text)`` are in each bucket: ``n`` numbers, whatever the size of the table."""
    rows = texts.select(F.explode(buckets(F.col("text"), orders, n)).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    out = [0] * n
    for r in rows:
        out[r["b"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln of the ratio of the smoothed shares) of every bucket."""
    n, S, T = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(S + n) / (float(s + 1) * float(T + n)))) for s, t in zip(source, target)]


def literal(values: list[int]) -> Column:
    """A literal array: one constant in the plan, not an expression a value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 of ``seed:doc_id`` (a null id is written as nothing)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, ...] = (1,), n: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_features, weight, score and rank (null where not drawn).

    ``target(text)`` holds the texts to resemble. Of the N rows with at least ``min_words`` words, floor(``percent`` * N / 100)
    of the highest scores are drawn and numbered from 1; equal scores go to the smaller doc_id, a null doc_id last. A null or
    empty text has no feature, weight 0 and its noise as score. Repeated rows are scored and drawn each (equal rows in any
    order); an empty ``docs`` gives an empty result, an empty ``target`` gains by rarity alone. Columns of the result's names
    are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in COLUMNS]
    gain = literal(gains(totals(docs, orders, n), totals(target, orders, n)))
    total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + F.element_at(gain, x + 1))
    # bound to a variable of its own, the array of a text is made once
    scored = F.transform(F.array(buckets(F.col("text"), orders, n)), lambda b: F.struct(F.size(b).cast("long").alias("n_features"), total(b).alias("sum")))[0]
    n_words = F.col("_storyspark_s.n_features") if orders == (1,) else F.size(words(F.col("text")))
    kept = without(docs, *COLUMNS).withColumn("_storyspark_s", scored).withColumn("_storyspark_w", n_words).withColumn("_storyspark_n", noise(F.col("doc_id"), seed))
    floored = "case when _storyspark_s.n_features = 0 then 0L else (_storyspark_s.sum - pmod(_storyspark_s.sum, _storyspark_s.n_features)) div _storyspark_s.n_features end"
    kept = kept.select(*names, F.col("_storyspark_s.n_features").alias("n_features"), F.expr(floored).alias("weight"), "_storyspark_n", (F.col("_storyspark_w") >= min_words).alias("_storyspark_in"))
    kept = materialize(kept.withColumn("score", F.col("weight") + F.col("_storyspark_n")))
    # scores are whole thousandths of logarithms: some ten thousand values at any size of the corpus
    held = sorted((r["score"], r["n"]) for r in kept.where("_storyspark_in").groupBy("score").agg(F.count("*").alias("n")).collect())
    drawn = percent * sum(c for _, c in held) // 100
    least, left = None, drawn
    while left > 0:
        least, c = held.pop()
        left -= c
    result = [*names, "n_features", "weight", "score"]
    if least is None:
        return kept.select(*result, F.lit(None).cast("long").alias("rank"))
    able = F.col("_storyspark_in") & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = ordering.numbered(kept.where(able).select(*result), order, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*result, "rank").unionByName(kept.where(~able).select(*result, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", *COLUMNS)


SQL = r"""
WITH RECURSIVE bit(n, c, k) AS (
  SELECT n, n, 0 FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bit WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY n) AS step FROM bit WHERE k = 8
), d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents
), dw AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d
), bw AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), v AS MATERIALIZED (
  SELECT w, hex(encode(w)) AS h, (SELECT step FROM crc) AS step FROM (SELECT w FROM dw UNION SELECT w FROM bw) u
), b AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda acc, x: xor(acc // 256, step[xor(acc % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM v
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY bucket
), g AS MATERIALIZED (
  SELECT k.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000e0) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000e0)))) AS BIGINT) AS gain
  FROM range(10000) k(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), n AS (SELECT r, sum(gain) AS total, count(*) AS n FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY r
), c AS MATERIALIZED (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight, ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN n USING (r)
), e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM c
), o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM o
"""
