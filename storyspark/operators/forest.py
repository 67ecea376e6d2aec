"""The event forest up to a chapter: nodes with their trees, causal links whose evidence is all known by then, foreshadowing threads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.operators import ordering
from storyspark.operators.graph_algorithms import cut


def roots(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, root, depth) of ``nodes(id)`` under ``parents(id, parent)`` by pointer doubling: as many joins as the depth has bits.

    A node without a parent is its own root; a cycle, a second parent or a node that is its own parent is an error.
    """
    if not parents.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an event has two parents")
    at = cut(nodes.select("id").join(parents.select("id", "parent"), "id", "left").select("id", F.coalesce("parent", "id").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth")))
    n = at.count()
    for _ in range(max(1, n).bit_length() + 1):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = cut(at.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        at = step.select("id", "root", "depth")
        # a depth beyond the number of nodes, or a root that has a parent, can only come from a cycle
        if not at.where(F.col("depth") >= max(n, 1)).isEmpty():
            raise ValueError("the parents have a cycle")
        if step.where("moved").isEmpty():
            break
    if not at.join(parents.select(F.col("id").alias("root")), "root", "left_semi").isEmpty():
        raise ValueError("the parents have a cycle")
    return at


def within(owners: DataFrame, key: str, evidence: DataFrame, allowed) -> DataFrame:
    """``owners`` all of whose evidence is allowed: none of ``evidence(owner, chapter)`` under their ``key`` is not. One without evidence stays."""
    outside = evidence.where(~F.coalesce(allowed(F.col("chapter")), F.lit(False))).select(F.col("owner").alias(key)).distinct()
    return owners.join(outside, key, "left_anti")


def causal_edges(links: DataFrame, evidence: DataFrame, chapters: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Causal ``links(link_id, source, target, type, is_active)`` between whole events, with all evidence of both ends in ``chapters(chapter)``.

    Inactive links go unless asked for; a null state counts as active. ``evidence(owner, chapter)`` is of events.
    """
    kept = links.where("type = 'causal' and source is not null and target is not null")
    if not include_inactive:
        kept = kept.where(F.coalesce("is_active", F.lit(True)))
    outside = cut(evidence.join(chapters.select("chapter").distinct(), "chapter", "left_anti").select("owner").distinct())
    for end in ("source", "target"):
        kept = kept.join(outside.withColumnRenamed("owner", end), end, "left_anti")
    return kept.select("link_id", "source", "target", "type", "is_active")


@dataclass
class Forest:
    nodes: DataFrame
    trees: DataFrame
    edges: DataFrame
    threads: DataFrame


def snapshot(events: DataFrame, evidence: DataFrame, parents: DataFrame, relations: DataFrame, relation_evidence: DataFrame, actions: DataFrame, boundary: int) -> Forest:
    """The forest as it stands after chapter ``boundary``.

    ``events(event_id, chapter, from_chapter, to_chapter, char_start, char_end)``: those of one chapter up to the boundary are nodes; evidence
    of another chapter than the event's is an error. ``parents(id, parent)`` count between nodes of one chapter. ``relations(relation_id,
    source, target, type)`` are edges if causal, both ends nodes, and all their evidence known by the boundary. ``actions(source, target,
    action, chapter, ord)`` (setup, reinforce, payoff) make a thread per root. Tables are of one run; ids are unique.
    """
    nodes = cut(events.where((F.col("chapter") <= boundary) & (F.col("from_chapter") == F.col("chapter")) & (F.col("to_chapter") == F.col("chapter"))))
    own = nodes.select(F.col("event_id").alias("owner"), F.col("chapter").alias("own"))
    if not evidence.join(own, "owner").where("chapter <> own").isEmpty():
        raise ValueError("evidence of an event is outside its chapter")
    up, down = own.select(F.col("owner").alias("parent"), F.col("own").alias("up")), own.select(F.col("owner").alias("id"), F.col("own").alias("down"))
    inner = cut(parents.join(down, "id").join(up, "parent").where("up = down").select("id", "parent"))
    root = roots(nodes.select(F.col("event_id").alias("id")), inner)
    told = nodes.join(root.select(F.col("id").alias("event_id"), F.col("root").alias("tree_id")), "event_id").join(inner.select(F.col("id").alias("event_id"), F.col("parent").alias("parent_event_id")), "event_id", "left")
    told = told.withColumn("cause_role", F.when(F.col("parent_event_id").isNull(), "root").otherwise("main"))
    told = ordering.numbered(told, [F.col("chapter"), F.col("char_start"), F.col("event_id")], "event_ordinal").withColumn("event_ordinal", F.col("event_ordinal") - 1)
    told = cut(told)
    trees = told.groupBy("tree_id").agg(F.sort_array(F.collect_set("chapter")).alias("chapters"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count("*").alias("nodes"))
    ids = told.select("event_id")
    edges = within(relations.where("type = 'causal'"), "relation_id", relation_evidence, lambda c: c <= boundary)
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("event_id", end), end, "left_semi")
    acts = actions.where(F.col("chapter") <= boundary).join(ids.withColumnRenamed("event_id", "source"), "source", "left_semi")
    place = F.struct("chapter", "ord")
    threads = acts.groupBy(F.col("source").alias("root_event_id")).agg(F.min_by("chapter", place).alias("first_chapter"), F.max_by(F.struct("chapter", "action", "target"), place).alias("last"))
    paid = threads.join(ids.select(F.col("event_id").alias("paid")), F.col("last.target") == F.col("paid"), "left")
    status = F.when(F.col("last.action") == "setup", "open").when(F.col("last.action") == "reinforce", "reinforced").otherwise("likely_paid_off")
    threads = paid.select("root_event_id", "first_chapter", F.col("last.chapter").alias("last_chapter"), F.when(F.col("last.action") == "payoff", F.col("paid")).alias("payoff_event_id"), status.alias("status"), (F.col("last.action") != "payoff").alias("active"))
    return Forest(told, trees, edges.select("relation_id", "source", "target"), threads)
