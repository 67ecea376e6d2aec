"""Dependency parses as nested columns: depth statistics inside each sentence's array, and parser output laid out over a paragraph.

The parser itself is a source: its output comes as arrays of sentences (words, parts of speech, heads and relations, entities).
Everything here is higher-order functions on those arrays, so a row stays a row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part-of-speech tags of each group (any other tag is in the last group), and entity types.
POS_GROUPS = {"noun": "n nh ni ns nz nr", "verb": "v vn", "adj": "a an", "adv": "d", "pron": "r", "num": "m", "quantifier": "q", "prep": "p", "conj": "c", "particle": "u", "punct": "wp"}
OTHER_POS, NO_TAG = "other", "o"
ENTITIES = {"Nh": "person", "Ni": "org", "Ns": "location"}
#: Conjunctions of compound sentences, and lengths under which a sentence is short or medium.
CONJUNCTIONS, SHORT, MEDIUM = ("但是", "虽然", "因为", "如果", "而且", "可是", "然而"), 10, 30


def _doubled(start: Column, rounds: Column) -> Column:
    """Steps to the end of every chain: ``start`` is an array of (to: place of the next, 0 at an end; steps so far), and each round doubles the way."""
    def step(state: Column, _: Column) -> Column:
        ahead = lambda x: F.element_at(state, x["to"])
        return F.transform(state, lambda x: F.when(x["to"] > 0, F.struct(ahead(x)["to"].alias("to"), (x["steps"] + ahead(x)["steps"]).alias("steps"))).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)


def depths(heads: Column, dependents: Column | None = None) -> Column:
    """Depth of every token of an array: 0 for a root (its head is 0 or null), else one more than its head's.

    A token whose head is no token has depth 1, so has every member of a cycle, and a token under a cycle counts from there. ``dependents``
    are the distinct numbers of the tokens; without them they are 1, 2, 3 and so on.
    """
    if dependents is None:
        at = lambda h: F.when(h.between(1, F.size(heads)), h).otherwise(0)
        place = F.transform(heads, lambda h: F.when(F.coalesce(h, F.lit(0)) == 0, F.struct(F.lit(0).alias("to"), F.lit(0).alias("steps"))).otherwise(F.struct(at(h).cast("int").alias("to"), F.lit(1).alias("steps"))))
    else:
        place = F.transform(heads, lambda h: F.when(F.coalesce(h, F.lit(0)) == 0, F.struct(F.lit(0).alias("to"), F.lit(0).alias("steps"))).otherwise(F.struct(F.array_position(dependents, h).cast("int").alias("to"), F.lit(1).alias("steps"))))
    rounds = F.ceil(F.log2(F.size(heads) + 1)).cast("int") + 1

    def solve(first: Column) -> Column:
        # after as many steps as there are tokens, whoever still has a next one stands in a cycle, and every member is stood on
        stuck = F.array_distinct(F.filter(F.transform(_doubled(first, rounds), lambda x: x["to"]), lambda t: t > 0))
        return F.transform(F.array(stuck), lambda c: F.transform(_doubled(F.transform(first, lambda x, i: F.when(F.array_contains(c, i + 1), F.struct(F.lit(0).alias("to"), F.lit(1).alias("steps"))).otherwise(x)), rounds), lambda x: x["steps"]))[0]

    # bound to variables of their own, the arrays are worked out once
    return F.when(F.size(heads) > 0, F.transform(F.array(place), solve)[0]).otherwise(F.array().cast("array<int>"))


def _counts(xs: Column) -> Column:
    """How often each string is in an array (nulls aside), as a map in order of the strings."""
    keys = F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.isNotNull())))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.size(F.filter(xs, lambda x: x == k)))))


def statistics(sentences: DataFrame, heads: str = "heads", relations: str = "relations", dependents: str | None = None) -> DataFrame:
    """``sentences`` with n_nodes, n_roots, depth_sum, depth_max and relation_counts (a map) of each row's arrays; null or empty ones have zeros."""
    kinds = dict(sentences.dtypes)
    of = lambda c: F.coalesce(F.col(c), F.array().cast(kinds[c]))
    out = sentences.withColumn("_storyspark_d", depths(of(heads), of(dependents) if dependents else None))
    return out.select(
        *sentences.columns, F.size(of(heads)).alias("n_nodes"), F.size(F.filter(of(heads), lambda x: F.coalesce(x, F.lit(0)) == 0)).alias("n_roots"), F.aggregate("_storyspark_d", F.lit(0), lambda acc, x: acc + x).alias("depth_sum"),
        F.coalesce(F.array_max("_storyspark_d"), F.lit(0)).alias("depth_max"), _counts(of(relations)).alias("relation_counts"),
    )


def _group(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def _laid_out(parsed: DataFrame) -> DataFrame:
    """``parsed`` with a row's sentences as structs: number, start in the text, first token's number, words, tags, heads, labels, entities.

    A sentence is sought from the end of the one before and stands there where it is not found; one without words takes no place.
    """
    starts = F.expr("""aggregate(arrays_zip(sentences, cws), cast(struct(1 as cursor, array() as at) as struct<cursor:int,at:array<int>>),
        (s, x) -> CASE WHEN coalesce(size(x.cws), 0) <= 0 THEN struct(s.cursor AS cursor, concat(s.at, array(s.cursor - 1)) AS at)
        ELSE struct(coalesce(nullif(locate(x.sentences, text, s.cursor), 0), s.cursor) + char_length(x.sentences) AS cursor, concat(s.at, array(coalesce(nullif(locate(x.sentences, text, s.cursor), 0), s.cursor) - 1)) AS at) END).at""")
    firsts = F.expr("aggregate(cws, cast(struct(1 as n, array() as at) as struct<n:int,at:array<int>>), (s, w) -> struct(s.n + greatest(coalesce(size(w), 0), 0) AS n, concat(s.at, array(s.n)) AS at)).at")
    get = lambda xs, i: F.get(F.col(xs), i)
    rows = parsed.where(F.size("cws") > 0).withColumn("_storyspark_s", starts).withColumn("_storyspark_f", firsts)
    body = F.transform("cws", lambda w, i: F.struct(i.alias("sentence"), get("_storyspark_s", i).alias("start"), get("_storyspark_f", i).alias("first"), w.alias("words"), get("pos", i).alias("tags"), get("dep", i).alias("dep"), get("ner", i).alias("ner")))
    return rows.withColumn("laid", F.filter(body, lambda x: F.size(x["words"]) > 0)).drop("_storyspark_s", "_storyspark_f")


def paragraph_tokens(parsed: DataFrame) -> DataFrame:
    """(paragraph_id, sentence, token, surface, pos, pos_group, start, stop) of ``parsed(paragraph_id, text, sentences, cws, pos, dep, ner)``.

    ``cws`` and ``pos`` are arrays of sentences of strings. Tokens count through the paragraph from 1; a sentence's words stand one after
    the other from its start. A missing tag is ``NO_TAG``.
    """
    prefix = lambda x, j: F.aggregate(F.slice(x["words"], F.lit(1), j), F.lit(0), lambda acc, w: acc + F.char_length(w))
    words = F.flatten(F.transform("laid", lambda x: F.transform(x["words"], lambda w, j: F.struct(x["sentence"].alias("sentence"), (x["first"] + j).alias("token"), w.alias("surface"), F.coalesce(F.get(x["tags"], j), F.lit(NO_TAG)).alias("pos"), (x["start"] + prefix(x, j)).alias("start")))))
    rows = _laid_out(parsed).select("paragraph_id", F.explode(words).alias("t")).select("paragraph_id", "t.*")
    tags = {t: g for g, ts in POS_GROUPS.items() for t in ts.split()}
    return rows.select("paragraph_id", "sentence", "token", "surface", "pos", F.coalesce(_group(tags, F.col("pos")), F.lit(OTHER_POS)).alias("pos_group"), "start", (F.col("start") + F.char_length("surface")).alias("stop"))


def _arcs() -> Column:
    own = lambda x: F.slice(x["dep"]["head"], F.lit(1), F.size(x["words"]))
    return F.flatten(F.transform(F.filter("laid", lambda x: x["dep"].isNotNull()), lambda x: F.transform(own(x), lambda h, j: F.struct(x["sentence"].alias("sentence"), (x["first"] + j).alias("dependent"), F.when(h == 0, 0).otherwise(h + x["first"] - 1).alias("head"), F.get(x["dep"]["label"], j).alias("relation")))))


def paragraph_arcs(parsed: DataFrame) -> DataFrame:
    """(paragraph_id, sentence, dependent, head, relation) of ``parsed``, by numbers of the paragraph's tokens (0: root).

    ``dep`` is an array of sentences of (head array<int>, label array<string>), heads by numbers of the sentence from 1; no sentence has more arcs than words.
    """
    return _laid_out(parsed).select("paragraph_id", F.explode(_arcs()).alias("a")).select("paragraph_id", "a.*")


def paragraph_entities(parsed: DataFrame) -> DataFrame:
    """(paragraph_id, sentence, surface, raw_type, type, start, stop) of ``parsed``; ``type`` is null for a type without a group.

    ``ner`` is an array of sentences of (type, surface, start, end); start is a place among the sentence's words, from 0.
    """
    upto = lambda x, n: F.aggregate(F.slice(x["words"], F.lit(1), n), F.lit(0), lambda acc, w: acc + F.char_length(w))
    found = F.flatten(F.transform(F.filter("laid", lambda x: x["ner"].isNotNull()), lambda x: F.transform(x["ner"], lambda e: F.struct(x["sentence"].alias("sentence"), e["surface"].alias("surface"), e["type"].alias("raw_type"), (x["start"] + upto(x, e["start"])).alias("start")))))
    rows = _laid_out(parsed).select("paragraph_id", F.explode(found).alias("e")).select("paragraph_id", "e.*")
    return rows.select("paragraph_id", "sentence", "surface", "raw_type", _group(ENTITIES, F.col("raw_type")).alias("type"), "start", (F.col("start") + F.char_length("surface")).alias("stop"))


def analyse(parsed: DataFrame) -> DataFrame:
    """One row per paragraph of ``parsed``: counts of tokens, word lengths, tags, sentences and their patterns, and the dependency statistics.

    A paragraph without sentences or words has zeros and empty maps. Patterns: short, medium or long, compound (with a conjunction), and
    parallel_candidate (the third of three successive sentences of one first character).
    """
    n = F.char_length
    size = lambda s: F.when(n(s) < SHORT, "short").when(n(s) < MEDIUM, "medium").otherwise("long")
    compound = lambda s: F.when(s.rlike("|".join(CONJUNCTIONS)), "compound")
    first = lambda i: F.left(F.get("sentences", i), F.lit(1))
    same = lambda i: F.when((i >= 2) & (first(i) != "") & (first(i) == first(i - 1)) & (first(i) == first(i - 2)), "parallel_candidate")
    patterns = F.flatten(F.transform("sentences", lambda s, i: F.array(size(s), compound(s), same(i))))
    words, length = F.flatten(F.transform("laid", lambda x: x["words"])), lambda w: F.when(n(w) >= 5, "5_plus").otherwise(n(w).cast("string"))
    tags = {t: g for g, ts in POS_GROUPS.items() for t in ts.split()}
    groups = F.flatten(F.transform("laid", lambda x: F.transform(x["words"], lambda w, j: F.coalesce(_group(tags, F.get(x["tags"], j)), F.lit(OTHER_POS)))))
    told = _laid_out(parsed).withColumn("_storyspark_a", _arcs())
    told = told.select("paragraph_id", F.size(words).alias("n_tokens"), _counts(F.transform(words, length)).alias("word_length_counts"), _counts(groups).alias("pos_counts"), _counts(patterns).alias("pattern_counts"), F.transform("_storyspark_a", lambda a: a["head"]).alias("heads"), F.transform("_storyspark_a", lambda a: a["dependent"]).alias("dependents"), F.transform("_storyspark_a", lambda a: a["relation"]).alias("relations"))
    told = statistics(told, dependents="dependents").drop("heads", "dependents", "relations")
    all_rows = parsed.select("paragraph_id", F.greatest(F.coalesce(F.size("sentences"), F.lit(0)), F.lit(0)).alias("n_sentences"))
    out = all_rows.join(told, "paragraph_id", "left")
    zero = {c: 0 for c in ("n_tokens", "n_nodes", "n_roots", "depth_sum", "depth_max")}
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return out.fillna(zero).withColumns({c: F.coalesce(c, empty) for c in ("word_length_counts", "pos_counts", "pattern_counts", "relation_counts")})
