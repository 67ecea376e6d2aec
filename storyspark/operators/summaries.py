"""Chapters and books summed up from their paragraphs' counters: ratios of sums, spread of sentence lengths, word variety, shares of labels.

A paragraph gives sums (characters, tokens, hits, sentences, their lengths and squares), a chapter adds them up, a book adds its chapters
up, so no ratio is a mean of ratios. Word variety is taken from the joined text, once a chapter and once a book.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import series
from storyspark.plans.dialect import TOKEN

SUMS = ("chars", "tok", "pos", "neg", "fight", "excl", "ques", "pause", "dlg", "sentences", "sentence_chars", "sentence_squares")
#: Ends of sentences.
BORDERS = "[。！？!?]+|\n+"


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b != 0, a.cast("double") / b), 6)


def with_sentences(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs(txt, ...)`` with the number of sentences, the sum of their lengths and of the squares; blank ones do not count."""
    lengths = F.filter(F.transform(F.split("txt", BORDERS), lambda x: F.char_length(F.trim(x)).cast("long")), lambda n: n > 0)
    add = lambda f: F.aggregate(lengths, F.lit(0).cast("long"), lambda acc, n: acc + f(n))
    return paragraphs.withColumns({"sentences": F.size(lengths).cast("long"), "sentence_chars": add(lambda n: n), "sentence_squares": add(lambda n: n * n)})


def _measures() -> dict[str, Column]:
    c = F.col
    mean = c("sentence_chars").cast("double") / c("sentences")
    spread = F.greatest(F.lit(0.0), c("sentence_squares").cast("double") / c("sentences") - mean * mean)
    per_100 = lambda x: _ratio(c(x) * 100, c("chars"))
    return {
        "pos_density": _ratio(c("pos"), c("tok")), "neg_density": _ratio(c("neg"), c("tok")), "net_density": _ratio(c("pos") - c("neg"), c("tok")), "fight_density": _ratio(c("fight"), c("tok")),
        "exclaim_per_100_chars": per_100("excl"), "question_per_100_chars": per_100("ques"), "pause_per_100_chars": per_100("pause"), "dialogue_ratio": _ratio(c("dlg"), c("chars")),
        "avg_sent_len": _ratio(c("sentence_chars"), c("sentences")), "sent_len_std": F.round(F.when(c("sentences") > 0, F.sqrt(spread)), 4),
    }


def _variety(df: DataFrame, with_mtld: bool) -> DataFrame:
    """Type-token ratio (and measure of textual lexical diversity) of the column ``text``; null without a token."""
    @F.pandas_udf("double")
    def mtld(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: series.mtld(list(t)) if len(t) else None)

    df = df.withColumn("_toks", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    df = df.withColumn("ttr", _ratio(F.size(F.array_distinct("_toks")), F.size("_toks")))
    return (df.withColumn("mtld", F.round(mtld("_toks"), 6)) if with_mtld else df).drop("_toks", "text")


def _joined(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """Sums and the text, paragraph after paragraph without anything between, of each group (a chapter or a book)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "txt"))), lambda x: x["txt"]), "")
    return paragraphs.groupBy(*keys).agg(F.count("*").alias("n_paragraphs"), *[F.sum(x).alias(x) for x in SUMS], text.alias("text"))


LABELS = ("narrative_function", "pivot_moment", "cliffhanger", "emotional_valence")


def chapter_summary(paragraphs: DataFrame, labels: DataFrame, with_mtld: bool = True) -> DataFrame:
    """One row per chapter of ``paragraphs(doc_id, ch, pid, txt, chars, tok, pos, neg, fight, excl, ques, pause, dlg)``, with the labels of ``labels(doc_id, ch, ...)``.

    A ratio whose denominator is 0 is null, and so are the labels of a chapter without any; the spread is that of the population.
    """
    rows = _joined(with_sentences(paragraphs), "doc_id", "ch")
    rows = _variety(rows.withColumns(_measures()), with_mtld).join(labels.select("doc_id", "ch", *LABELS), ["doc_id", "ch"], "left")
    return rows.withColumn("narrative_function", F.nullif("narrative_function", F.lit(""))).drop("sentences", "sentence_chars", "sentence_squares", "pos", "neg", "fight", "excl", "ques", "pause", "dlg")


def book_summary(paragraphs: DataFrame, labels: DataFrame, with_mtld: bool = True) -> DataFrame:
    """One row per book: the same measures over its sums and whole text, rates of pivots and cliffhangers and shares of functions and valences.

    A rate or share is of the chapters that have the label at all; without one it is null (rates) or an empty map (shares).
    """
    told = with_sentences(paragraphs)
    books = _variety(_joined(told, "doc_id").withColumns(_measures()), with_mtld)
    chapters = told.groupBy("doc_id", "ch").agg(F.count("*").alias("n")).join(labels.select("doc_id", "ch", *LABELS), ["doc_id", "ch"], "left").withColumn("narrative_function", F.nullif("narrative_function", F.lit("")))
    rates = chapters.groupBy("doc_id").agg(F.count("*").alias("n_chapters"), F.round(F.avg(F.col("pivot_moment").cast("double")), 6).alias("pivot_rate"), F.round(F.avg(F.col("cliffhanger").cast("double")), 6).alias("cliffhanger_rate"))
    out = books.join(rates, "doc_id")
    for label, name in (("narrative_function", "function_share"), ("emotional_valence", "valence_share")):
        n = chapters.where(F.col(label).isNotNull()).groupBy("doc_id", F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
        n = n.groupBy("doc_id").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("x"))  # as many as labels
        share = F.map_from_entries(F.transform("x", lambda e: F.struct(e["label"], F.round(e["n"] / F.col("all"), 6))))
        out = out.join(n.select("doc_id", share.alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    return out.drop("sentences", "sentence_chars", "sentence_squares", "pos", "neg", "fight", "excl", "ques", "pause", "dlg")


def book_statistics(paragraphs: DataFrame, with_mtld: bool = True) -> DataFrame:
    """(doc_id, name, value) of each book: up to sixteen statistics of ``paragraphs(doc_id, ch, pid, txt, chars, tok, pos, neg, net, tension)``.

    Densities are of sums; spread (of the population), extremes and their chapters are of the paragraphs' own values, of equal ones the last
    paragraph. ``net`` and ``tension`` may be null (no value), ``pos`` and ``neg`` too (not measured: such text is not without hits). A
    statistic without anything to be taken from is absent.
    """
    rows = with_sentences(paragraphs)
    hits = F.col("pos").isNotNull() & F.col("neg").isNotNull()
    zero = hits & (F.col("pos") == 0) & (F.col("neg") == 0)

    def extremes(x: str) -> list[Column]:
        has, v = F.col(x).isNotNull(), F.col(x).cast("double")
        at = lambda sign: F.max_by(F.when(has, F.col("ch")), F.when(has, F.struct(sign * v, F.col("pid"))))
        return [F.count(x).alias(f"{x}_n"), F.avg(v).alias(f"{x}_avg"), F.stddev_pop(v).alias(f"{x}_std"), F.max(v).alias(f"{x}_max"), F.min(v).alias(f"{x}_min"), at(1).alias(f"{x}_peak"), at(-1).alias(f"{x}_low")]

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "txt"))), lambda x: x["txt"]), "")
    sums = [F.sum(x).alias(x) for x in ("tok", "pos", "neg", "sentences", "sentence_chars")]
    s = rows.groupBy("doc_id").agg(*sums, F.sum(F.when(hits, F.col("chars"))).alias("measured"), F.sum(F.when(zero, F.col("chars"))).alias("zero"), *extremes("net"), *extremes("tension"), text.alias("text"))
    s = _variety(s, with_mtld)
    c = lambda x: F.col(x).cast("double")
    stats = [("avg_ttr", "ttr", c("ttr")), ("avg_sent_len", "sentences", c("sentence_chars") / c("sentences")), ("emotion_avg", "tok", (F.coalesce(c("pos"), F.lit(0.0)) - F.coalesce(c("neg"), F.lit(0.0))) / c("tok")), ("lexicon_zero_hit_share", "measured", F.coalesce(c("zero"), F.lit(0.0)) / c("measured"))]
    stats += [("avg_mtld", "ttr", c("mtld"))] if with_mtld else []
    for x, name in (("net", "emotion"), ("tension", "rhythm")):
        stats += [(f"{name}_{k}", f"{x}_n", c(f"{x}_{of}")) for k, of in (("avg", "avg"), ("std", "std"), ("max", "max"), ("min", "min"), ("peak_chapter_id", "peak"), ("min_chapter_id", "low")) if (name, k) != ("emotion", "avg")]
    told = F.array(*[F.when(F.col(present) > 0, F.struct(F.lit(name).alias("name"), F.round(F.when(F.col(present) > 0, value), 6).alias("value"))) for name, present, value in stats])
    return s.select("doc_id", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("s")).select("doc_id", "s.*")
