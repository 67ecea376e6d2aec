"""Queries on tiny tables with results worked out by hand, apart from the query texts."""

import datetime

import numpy as np
import pytest

from storyspark.operators import graph_algorithms as G
from storyspark.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")

    path = f"file://{tmp_path_factory.mktemp('tiny')}"
    t = datetime.datetime(2024, 1, 1)
    write("events", [(1, t, 1, "click", -4.0, "{}"), (2, t, 1, "click", 2.0, "{}"), (3, t, 2, "purchase", -1.0, "{}"), (4, t, 2, "purchase", None, "{}"), (5, t, 2, "view", 99.0, "{}")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    write("customer", [(1, "c1", 7, 0.0, "BUILDING"), (26, "c2", 7, 0.0, "BUILDING"), (32, "c3", 1, 0.0, "BUILDING"), (2, "c4", 9, 0.0, "AUTOMOBILE"), (9, "c5", 2, 0.0, "AUTOMOBILE")], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    write("embeddings", [(1, [-0.8, 1.0], 0), (2, [-0.79, 1.0], 0), (3, [-2.0, 1.0], 0), (4, [0.0, 0.0], 0), (5, [3.0, -9.0], 1), (6, [0.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    return path


def rows(spark, folder, name):
    return sorted(map(tuple, registry.queries()[name](spark, folder).collect()))


def test_group_gap(spark, folder):
    assert rows(spark, folder, "group_gap") == [(2.0,)]  # (4 + 2) / 2 - 1


def test_relation_key(spark, folder):
    # 1 and 7 both ways round are one relation, 9 to 2 and 2 to 9 are two
    assert rows(spark, folder, "relation_key") == [(1, 7, "BUILDING", 3), (2, 9, "AUTOMOBILE", 1), (9, 2, "AUTOMOBILE", 1)]


def test_strong_negative_share(spark, folder):
    got = {r[0]: r[1] for r in rows(spark, folder, "strong_negative_share")}
    assert got == {0: round(1 / 3, 6) if np.float32(-0.8) > -0.8 else round(2 / 3, 6), 1: 0.0, 2: None}


def test_hits(spark):
    edges = [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (3, 4, 0.5)]
    a = np.zeros((5, 5))
    for x, y, w in edges:
        a[x, y] = a[y, x] = w
    x = np.ones(4)
    for _ in range(1000):
        y = a[1:, 1:].T @ (a[1:, 1:] @ x)
        x, before = y / y.sum(), x
        if np.allclose(x, before, atol=1e-12, rtol=0):
            break
    h = a[1:, 1:] @ x
    got = {r["node"]: r for r in G.hits(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    assert np.allclose([got[i]["authority"] for i in range(1, 5)], x, atol=1e-9) and np.allclose([got[i]["hub"] for i in range(1, 5)], h / h.sum(), atol=1e-9)
    assert all(r["authority"] == 0 == r["hub"] for r in G.hits(spark.createDataFrame([(1, 2, 0.0)], "a long, b long, w double")).collect())


def test_paragraph_spans(spark):
    from storyspark.operators import paragraphs

    long = "甲" * 900 + "。" + "乙" * 700 + "；" + "丙" * 1600
    text = f"　一 \n\n二二\n{long}\n  "
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n\t"), (4, "x")], "doc_id long, text string")
    got = [tuple(r)[1:] for r in paragraphs.split(df).orderBy("doc_id", "paragraph").collect()]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(0, 0, 0, 1, 2), (1, 2, 0, 5, 7), (2, 3, 0, 8, 909), (3, 3, 1, 909, 2409), (4, 3, 2, 2409, 3210), (0, 0, 0, 0, 1)]
    assert all(text[r[3] : r[4]] == r[5] for r in got[:-1]) and got[2][5].endswith("甲。") and got[3][5].startswith("乙") and got[3][5].endswith("丙")


def test_trend_class(spark, tmp_path):
    # the words of dialect.LEXICONS: "the" is positive, "of" negative, "xxx" neither; all lines are equally long
    pos, neg, flat = "the xxx", "xxx  of", "xxx xxx"
    docs = {1: [flat] * 3, 2: [neg] * 3 + [pos] * 3, 3: [flat, pos], 4: [flat] * 400 + [pos] + [flat] * 100}
    spark.createDataFrame([(k, "\n".join(v), "en", "s", 0) for k, v in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.queries()["trend_class"](spark, f"file://{tmp_path}").collect()}
    assert [got[k]["trend"] for k in (1, 2, 3)] == ["stable", "volatile", "stable"] and got[3]["last_avg"] == 0.0
    # thirds at 1/3 and 2/3 of the way: the ends weigh a step, as the others do
    assert (got[2]["first_avg"], got[2]["middle_avg"], got[2]["last_avg"]) == (-0.5, 0.0, 0.5)
    assert got[4]["trend"] == "volatile" and got[4]["first_avg"] == 0.0 and got[4]["last_avg"] == pytest.approx(0.5 / 167, abs=1e-6)


def test_health_score(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 12)
    ago = lambda m: t - datetime.timedelta(minutes=m)
    rows = [(1, ago(0), 1, "view", 0.0, ""), (2, ago(5), 1, "error", 10.0, ""), (3, ago(40), 1, "view", 20.0, ""), (4, ago(100), 2, "error", None, ""), (5, ago(30), 3, "view", -5.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r["user_id"]: (r["n"], r["rn"], r["score"]) for r in registry.queries()["health_score"](spark, f"file://{tmp_path}").collect()}
    token = lambda x: 1 / (1 + x / 20_000)
    one = 0.05 * 2 / 3 + 0.2 / 2 + 0.45 / 2 + 0.05 / (1 + 3000 / 2e6) + 0.05 * token(1000) + 0.05 * token(500) + 0.1 / (1 + 10_000 / 30_000) + 0.05 * 3 / 50
    two = 0 + 0.2 + 0.45 + 0.05 * 3 + 0.1 + 0.05 / 50  # its failure is long ago; 30 points at most for 100 idle minutes
    assert got == {1: (3, 2, round(100 * one, 1)), 2: (1, 0, 100.0 if 100 * two + 30 > 100 else round(100 * two + 30, 1)), 3: (1, 1, 100.0)}


def test_summaries_by_hand(spark):
    from storyspark.functions import series
    from storyspark.operators import summaries

    cols = "doc_id long, ch long, pid long, txt string, chars long, tok long, pos long, neg long, fight long, excl long, ques long, pause long, dlg long"
    rows = [(1, 1, 0, "Ab cd! Ef?", 10, 3, 2, 1, 0, 1, 1, 0, 0), (1, 1, 1, "gh", 2, 1, 0, 0, 1, 0, 0, 0, 2), (1, 2, 2, "。!", 2, 0, 0, 0, 0, 1, 0, 0, 0), (2, 1, 0, "x x x x", 7, 4, 0, 4, 0, 0, 0, 0, 0)]
    labels = spark.createDataFrame([(1, 1, "turn", True, None, -2), (1, 2, "", False, None, None), (2, 9, "lost", True, True, 1)], "doc_id long, ch long, narrative_function string, pivot_moment boolean, cliffhanger boolean, emotional_valence int")
    para = spark.createDataFrame(rows, cols)
    c = {(r["doc_id"], r["ch"]): r for r in summaries.chapter_summary(para, labels).collect()}
    one = c[1, 1]
    # sentences of 5, 2 and 2 characters; "Efgh" is one token of the joined text only where nothing stands between
    assert (one["pos_density"], one["net_density"], one["exclaim_per_100_chars"], one["dialogue_ratio"]) == (0.5, 0.25, 8.333333, 0.166667)
    assert one["avg_sent_len"] == 3.0 and one["sent_len_std"] == round((33 / 3 - 9) ** 0.5, 4) and one["ttr"] == 1.0 and one["mtld"] == pytest.approx(series.mtld(["Ab", "cd", "Ef", "gh"]), abs=1e-6)
    assert (one["narrative_function"], one["pivot_moment"], one["cliffhanger"], one["emotional_valence"]) == ("turn", True, None, -2)
    two = c[1, 2]
    assert two["pos_density"] is two["avg_sent_len"] is two["sent_len_std"] is two["ttr"] is two["mtld"] is two["narrative_function"] is None and two["pivot_moment"] is False
    assert c[2, 1]["ttr"] == 0.25 and c[2, 1]["pivot_moment"] is None
    b = {r["doc_id"]: r for r in summaries.book_summary(para, labels).collect()}
    assert (b[1]["n_chapters"], b[1]["n_paragraphs"], b[1]["chars"], b[1]["pivot_rate"], b[1]["cliffhanger_rate"], b[1]["function_share"], b[1]["valence_share"]) == (2, 3, 14, 0.5, None, {"turn": 1.0}, {"-2": 1.0})
    assert (b[2]["pivot_rate"], b[2]["function_share"], b[2]["neg_density"]) == (None, {}, 1.0)


def test_book_statistics_by_hand(spark):
    from storyspark.operators import summaries

    cols = "doc_id long, ch long, pid long, txt string, chars long, tok long, pos double, neg double, net double, tension double"
    rows = [(1, 1, 0, "a b!", 4, 2, 1.0, 0.0, 0.5, 0.2), (1, 2, 1, "c", 2, 1, 0.0, 0.0, 0.0, 0.7), (1, 2, 2, "", 0, 0, 0.0, 0.0, None, 0.7), (1, 3, 3, "d", 10, 1, None, None, 0.5, None), (1, 4, 4, "e", 4, 1, 0.0, 0.0, 0.0, 0.2), (2, 1, 0, "。", 1, 0, None, None, None, None)]
    got: dict = {}
    for r in summaries.book_statistics(spark.createDataFrame(rows, cols)).collect():
        got.setdefault(r["doc_id"], {})[r["name"]] = r["value"]
    assert set(got) == {1} and len(got[1]) == 16  # the second book has nothing to tell
    b = got[1]
    assert (b["avg_sent_len"], b["emotion_avg"], b["lexicon_zero_hit_share"]) == (1.5, 0.2, 0.6)
    assert (b["emotion_max"], b["emotion_min"], b["emotion_std"], b["emotion_peak_chapter_id"], b["emotion_min_chapter_id"]) == (0.5, 0.0, 0.25, 3.0, 4.0)
    assert (b["rhythm_avg"], b["rhythm_std"], b["rhythm_peak_chapter_id"], b["rhythm_min_chapter_id"]) == (0.45, 0.25, 2.0, 4.0)


def test_foreshadowing_by_hand(spark):
    from storyspark.operators import foreshadowing as f

    acts = spark.createDataFrame([(1, "setup", None, 1, 1), (1, "payoff", 9, 4, 2), (1, "reinforce", None, 2, 7), (2, "setup", None, 3, 1), (2, "reinforce", None, 3, 2), (None, "setup", None, 1, 1), (4, "setup", None, None, 1)], "root long, action string, target long, chapter long, ord long")
    t = {r["root"]: r for r in f.trees(acts).collect()}
    assert set(t) == {1, 2, 4} and (t[1]["first_chapter"], t[1]["last_chapter"], t[1]["chapters"], t[1]["status"], t[1]["active"], t[1]["last_target"]) == (1, 4, [1, 2, 4], "likely_paid_off", False, 9)
    assert (t[2]["status"], t[2]["n_actions"], t[2]["chapters"], t[4]["chapters"]) == ("reinforced", 2, [3], [])
    roots = spark.createDataFrame([("a", 1, "high", 1), ("a", 1, "low", 2), ("a", 2, "", 3), ("a", 3, None, 4), ("b", 2, None, 1)], "run string, root long, likelihood string, ord int")
    got = dict(map(tuple, f.expectation(roots, acts).collect()))
    # 1: high, paid off, three actions (over 1, so 1); 2: medium's base, reinforced, two; 3: never acted on
    parts = [(1.0, 1.2 + 0.2 + 0.05), (0.38 + 0.03 - 0.05 + 0.04, 1.0 + 0.1 - 0.05), (0.38 - 0.07 - 0.05, 0.75 - 0.05)]
    assert got["a"] == pytest.approx(sum(s * w for s, w in parts) / sum(w for _, w in parts), abs=6e-5) and got["b"] is None and len(got) == 2
