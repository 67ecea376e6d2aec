"""Dependency depths on hand-made trees, cycles and loose ends; parser output over a paragraph."""

import random

from pyspark.sql import functions as F

from storyspark.operators import dependency


def walked(dependents, heads):
    """Depths by walking: a chain ends at a root, at a head that is no token, or at the first member of a cycle."""
    of, out = dict(zip(dependents, heads)), []

    def in_cycle(x):
        seen, at = set(), of.get(x)
        while at in of and at not in seen and at != x:
            seen.add(at)
            at = of[at]
        return at == x

    for x in dependents:
        n = 0
        while x in of and of[x] not in (0, None) and not in_cycle(x):
            x, n = of[x], n + 1
        out.append(n + (x in of and of[x] not in (0, None)))
    return out


def test_depths(spark):
    rng = random.Random(6)
    rows = [([1, 2, 3], [2, 0, 2]), ([1, 2, 3, 4], [2, 3, 1, 3]), ([1, 2], [1, 9]), ([], []), ([5, 7], [7, 0]), ([1, 2, 3], [None, 1, 2])]
    for _ in range(200):
        n = rng.randint(1, 12)
        rows.append((list(range(1, n + 1)), [rng.randint(0, n + 1) for _ in range(n)]))
    rows.append((list(range(1, 101)), list(range(100))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d array<int>, h array<int>")
    both = df.select("i", dependency.depths(F.col("h"), F.col("d")).alias("x"), dependency.depths(F.col("h")).alias("y")).orderBy("i").collect()
    assert [r["x"] for r in both] == [walked(*r) for r in rows]
    assert all(r["y"] == r["x"] for r, (d, _) in zip(both, rows) if d == list(range(1, len(d) + 1)))


PARSED = "paragraph_id int, text string, sentences array<string>, cws array<array<string>>, pos array<array<string>>, dep array<struct<head:array<int>,label:array<string>>>, ner array<array<struct<type:string,surface:string,start:int,end:int>>>"


def test_paragraph(spark):
    one = (1, "  张三去北京。 因为他累了。", ["张三去北京。", "因为他累了。"], [["张三", "去", "北京", "。"], ["因为", "他", "累", "了", "。"]], [["nh", "v", "ns", "wp"], ["c", "r", "a"]], [([2, 0, 2, 2], ["SBV", "HED", "VOB", "WP"]), ([3, 3, 0, 3, 3], ["ADV", "SBV", "HED", "RAD", "WP"])], [[("Nh", "张三", 0, 0), ("Ns", "北京", 2, 2)], [("Xx", "他", 1, 1)]])
    df = spark.createDataFrame([one, (2, "", [], [], [], [], []), (3, "a.", ["a."], None, None, None, None)], PARSED)
    toks = [tuple(r)[1:] for r in dependency.paragraph_tokens(df).orderBy("token").collect()]
    assert toks[:4] == [(0, 1, "张三", "nh", "noun", 2, 4), (0, 2, "去", "v", "verb", 4, 5), (0, 3, "北京", "ns", "noun", 5, 7), (0, 4, "。", "wp", "punct", 7, 8)]
    assert toks[4] == (1, 5, "因为", "c", "conj", 9, 11) and toks[7] == (1, 8, "了", "o", "other", 13, 14) and len(toks) == 9
    assert all(one[1][a:b] == w for _, _, w, _, _, a, b in toks)
    arcs = [tuple(r)[1:] for r in dependency.paragraph_arcs(df).orderBy("dependent").collect()]
    assert arcs[:2] == [(0, 1, 2, "SBV"), (0, 2, 0, "HED")] and arcs[4] == (1, 5, 7, "ADV") and arcs[6] == (1, 7, 0, "HED")
    entities = [tuple(r)[1:] for r in dependency.paragraph_entities(df).orderBy("start").collect()]
    assert entities == [(0, "张三", "Nh", "person", 2, 4), (0, "北京", "Ns", "location", 5, 7), (1, "他", "Xx", None, 11, 12)]
    rows = {r["paragraph_id"]: r.asDict() for r in dependency.analyse(df).collect()}
    assert rows[1]["pos_counts"] == {"noun": 2, "verb": 1, "punct": 1, "conj": 1, "pron": 1, "adj": 1, "other": 2} and rows[1]["word_length_counts"] == {"1": 6, "2": 3}
    assert rows[1]["pattern_counts"] == {"short": 2, "compound": 1} and (rows[1]["n_nodes"], rows[1]["n_roots"], rows[1]["depth_sum"], rows[1]["depth_max"]) == (9, 2, 7, 1)
    assert (rows[2]["n_sentences"], rows[2]["n_tokens"], rows[2]["depth_max"], rows[2]["pos_counts"]) == (0, 0, 0, {}) and rows[3]["n_sentences"] == 1 and rows[3]["n_tokens"] == 0
