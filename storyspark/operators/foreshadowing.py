"""Foreshadowing: the actions on each root (setup, reinforce, payoff) as a thread, and how much of what was set up may still be expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State of a thread by its last action.
STATUS = {"setup": "open", "reinforce": "reinforced", "payoff": "likely_paid_off"}
#: Score of a root by its likelihood of payoff, what its state and likelihood add, and the parts of its weight.
BASE, STATUS_BONUS, STRENGTH_BONUS = {"high": 0.62, "medium": 0.38, "low": 0.14}, {"open": -0.07, "reinforced": 0.03, "likely_paid_off": 0.28}, {"high": 0.03, "medium": 0.0, "low": -0.05}
STATUS_WEIGHT, STRENGTH_WEIGHT = {"open": 0.75, "reinforced": 1.0, "likely_paid_off": 1.2}, {"high": 0.05, "medium": 0.0, "low": -0.05}
#: What two and three or more actions add to score and weight.
HITS_BONUS, HITS_WEIGHT = (0.04, 0.08), (0.10, 0.20)


def _of(table: dict[str, float], key: Column, default: str) -> Column:
    at = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(at[F.coalesce(key, F.lit(default))], F.lit(table[default]))


def _by_hits(hits: Column, values: tuple[float, float]) -> Column:
    return F.when(hits >= 3, values[1]).when(hits == 2, values[0]).otherwise(0.0)


def trees(actions: DataFrame) -> DataFrame:
    """One row per root of ``actions(root, action, target, chapter, ord)``: first and last chapter and action, the chapters in order, state.

    The order is (chapter, ord). Actions without a root are in no tree; null chapters are in no list. ``status`` is that of the last action.
    """
    acts, place = actions.where("root is not null"), F.struct("chapter", "ord")
    told = acts.groupBy("root").agg(
        F.count("*").alias("n_actions"), F.min_by(F.struct("chapter", "action"), place).alias("first"), F.max_by(F.struct("chapter", "action", "target"), place).alias("last"), F.array_sort(F.collect_set("chapter")).alias("chapters")
    )  # a root's chapters: as many as a book has
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("last.action")]
    return told.select("root", "n_actions", F.col("first.chapter").alias("first_chapter"), F.col("first.action").alias("first_action"), F.col("last.chapter").alias("last_chapter"), F.col("last.action").alias("last_action"), F.col("last.target").alias("last_target"), "chapters", status.alias("status"), (F.col("last.action") != "payoff").alias("active"))


def expectation(roots: DataFrame, actions: DataFrame, key: str = "run") -> DataFrame:
    """(run, expectation) of ``roots(run, root, likelihood, ord)`` and ``actions(root, action, target, chapter, ord)``: a weighted mean of the roots' scores.

    A root that was set up several times counts once, as it was first (least ``ord``). Without any likelihood in a run its expectation is
    null; a run without roots has no row. A root without actions is open and counts as one hit.
    """
    first = roots.groupBy(key, "root").agg(F.min_by("likelihood", "ord").alias("likelihood"))
    told = first.join(trees(actions).select("root", "n_actions", "status"), "root", "left")
    status, hits, likely = F.coalesce("status", F.lit("open")), F.greatest(F.coalesce("n_actions", F.lit(1)), F.lit(1)), F.nullif(F.col("likelihood"), F.lit(""))
    score = _of(BASE, likely, "medium") + _of(STATUS_BONUS, status, "open") + _of(STRENGTH_BONUS, likely, "low") + _by_hits(hits, HITS_BONUS)
    weight = _of(STATUS_WEIGHT, status, "open") + _by_hits(hits, HITS_WEIGHT) + _of(STRENGTH_WEIGHT, likely, "low")
    told = told.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).withColumn("weight", weight)
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return told.groupBy(key).agg(F.round(F.when(F.count("likelihood") > 0, mean), 4).alias("expectation"))
