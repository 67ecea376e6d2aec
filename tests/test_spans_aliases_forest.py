"""Term spans against brute force, containment pairs against the nested loop, the event forest against recursion and on broken input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storyspark.functions import spans
from storyspark.operators import aliases, forest
from storyspark.plans.dialect import TOKEN

SF = "/root/testdata/sf0.001"


def located(text, tokens, terms):
    """The spans by plain search: every candidate is compared with every span taken before."""
    terms = {t.strip() for t in terms if t and t.strip()}
    places = [(i, i + len(t), t) for t in terms if len(t) >= 2 for i in range(len(text)) if text.startswith(t, i)]
    free = lambda x, taken: all(x[1] <= s or x[0] >= e for s, e, _ in taken)
    cursor, words = 0, []
    for t in (t.strip() for t in tokens):
        if t in terms:
            at = text.find(t, cursor) if text.find(t, cursor) >= 0 else text.find(t)
            if at >= 0:
                words.append((at, at + len(t), t))
                cursor = at + len(t)
    taken = []
    for x in sorted(places + words, key=lambda x: (x[0] - x[1], x[0], x[2])):
        if free(x, taken):
            taken.append(x)
    left, out, cursor = [t for *_, t in taken], [], 0
    for x in sorted(places, key=lambda x: (x[0] - x[1], x[2], x[0])):
        if free(x, out) and x[2] in left:
            out.append(x)
            left.remove(x[2])
    for t in tokens:
        w = t.strip()
        if w in terms:
            at = text.find(w, cursor) if text.find(w, cursor) >= 0 else text.find(w)
            if at >= 0:
                x = (at, at + len(w), w)
                if free(x, out) and w in left:
                    out.append(x)
                    left.remove(w)
                cursor = at + len(w)
        elif t:
            cursor = text.find(t, cursor) + len(t) if text.find(t, cursor) >= 0 else cursor + len(t)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_spans_brute(seed):
    rng = random.Random(seed)
    for _ in range(300):
        letters = ["ab", "abc ", "心高兴不 ab"][seed]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        terms = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7))]
        tokens = re.findall(r"[a-z]+|[一-鿿]{1,2}", text)
        if tokens and rng.random() < 0.5:
            tokens.insert(rng.randrange(len(tokens)), rng.choice(["b", "zz", " a "]))
        a = spans.Automaton(terms)
        assert sorted(a.find(text)) == sorted((i, i + len(t), t) for t in a.terms for i in range(len(text)) if text.startswith(t, i))
        assert spans.locate(text, tokens, a) == located(text, tokens, terms), (text, terms, tokens)


def test_spans_odd(spark, monkeypatch):
    a = spans.Automaton(["高兴", "兴", " ", None, "不高兴"])
    assert a.terms == ["不高兴", "兴", "高兴"]
    assert spans.locate("他不高兴，高兴", ["他", "不", "高兴", "高兴"], a) == [(1, 4, "不高兴"), (5, 7, "高兴")]
    assert spans.locate(None, [], a) == spans.locate("", ["x"], a) == spans.locate("abc", ["abc"], spans.Automaton([])) == []
    assert spans.fixed_phrases("一心一意地向前走了很远啊 abc", spans.Automaton(["一心一意", "向前"])) == [(0, 4, "lexicon"), (5, 7, "lexicon"), (7, 11, "run")]
    df = spark.createDataFrame([(1, "not good 好人 good"), (2, None), (None, "good"), (1, "")], "doc_id long, text string")
    assert sorted(map(tuple, spans.emotion_spans(df, ["good", "好人"], TOKEN).collect())) == [(1, 4, 8, "good"), (1, 9, 11, "好人"), (1, 12, 16, "good")]
    monkeypatch.setattr(spans, "LEXICON_BYTES", 3)
    with pytest.raises(ValueError):
        spans.Automaton(["good"])


def test_emotion_spans_query(spark):
    from storyspark.plans import registry
    from storyspark.plans.dialect import LEXICONS

    terms = [t for w in LEXICONS.values() for t in w]
    got: dict = {}
    for r in registry.queries()["emotion_spans"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["term"]))
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).collect()[:60]:
        text = r["text"] or ""
        assert sorted(got.get(r["doc_id"], [])) == located(text, re.findall(TOKEN, text), terms)


@pytest.mark.parametrize("seed", range(2))
def test_aliases_brute(spark, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abc 贺伯安") for _ in range(rng.randint(0, 14))) for _ in range(250)]
    names += [n[rng.randrange(3) : -1] for n in names[:80]] + [None, "", names[0], "a"]
    rows = [(i, n) for i, n in enumerate(names)] + [(None, "ab")]
    want = {(min(i, j), max(i, j)) for i, a in rows for j, b in rows if i is not None and j is not None and a and b and a != b and len(a) >= 2 and a in b}
    df = spark.createDataFrame(rows, "id long, name string")
    got = aliases.containment_pairs(df)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert aliases.containment_pairs(df.limit(0)).count() == 0


def test_aliases_broadcast_no_grams(spark, monkeypatch):
    names = ["old rod", "cold rod", "rod", "Nan", "Nancy", "anc"]
    rows = [(i, n) for i, n in enumerate(names * 60)] + [(1000, "ab"), (1000, "abc"), (1001, "ab"), (1001, "abc")]
    want = sorted({(min(i, j), max(i, j), a, b) for i, a in rows for j, b in rows if a != b and a in b})
    df = spark.createDataFrame(rows, "id long, name string")
    monkeypatch.setattr(aliases, "BLOCK", 16, raising=False)
    for most in (1 << 16, 0):  # what asks is broadcast, or shuffled
        monkeypatch.setattr(aliases, "BROADCAST", most, raising=False)
        got = aliases.containment_pairs(df)
        assert sorted(map(tuple, got.collect())) == want
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_roots_and_cycles(spark):
    nodes = spark.range(1, 41).select("id")
    chain = frame(spark, "id long, parent long", *[(i, i - 1) for i in range(2, 21)], (30, 25), (31, 30))
    got = {r["id"]: (r["root"], r["depth"]) for r in forest.roots(nodes, chain).collect()}
    assert got[20] == (1, 19) and got[1] == (1, 0) and got[31] == (25, 2) and got[40] == (40, 0) and len(got) == 40
    for loop in ([(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 2)], [(i, i % 7 + 1) for i in range(1, 8)]):
        with pytest.raises(ValueError):
            forest.roots(nodes, frame(spark, "id long, parent long", *loop))
    with pytest.raises(ValueError):
        forest.roots(nodes, frame(spark, "id long, parent long", (1, 2), (1, 3)))


def test_causal_edges(spark):
    links = frame(spark, "link_id long, source long, target long, type string, is_active boolean", (1, 1, 2, "causal", None), (2, 1, 3, "causal", True), (3, 2, 1, "causal", False), (4, 1, None, "causal", True), (5, 1, 2, "contrast", True), (6, 2, 4, "causal", True))
    evidence = frame(spark, "owner long, chapter long", (1, 1), (2, 1), (2, 2), (3, 1), (3, 9))
    ids = lambda **k: sorted(r["link_id"] for r in forest.causal_edges(links, evidence, frame(spark, "chapter long", (1,), (2,)), **k).collect())
    assert ids() == [1, 6] and ids(include_inactive=True) == [1, 3, 6]  # event 4 has no evidence, none of it is outside


def test_forest_rejects_strange_evidence(spark):
    events = frame(spark, "event_id long, chapter long, from_chapter long, to_chapter long, char_start long, char_end long", (1, 1, 1, 1, 0, 5), (2, 1, 1, 1, 6, 9), (3, 2, 2, 2, 10, 12), (4, 2, 1, 2, 0, 3))
    none = lambda schema: spark.createDataFrame([], schema)
    parents = frame(spark, "id long, parent long", (2, 1), (3, 1))
    relations = frame(spark, "relation_id long, source long, target long, type string", (7, 1, 3, "causal"), (8, 2, 1, "causal"), (9, 1, 4, "causal"))
    proof = frame(spark, "owner long, chapter long", (7, 1), (7, 3), (8, 1))
    actions = frame(spark, "source long, target long, action string, chapter long, ord long", (1, None, "setup", 1, 1), (1, 3, "payoff", 2, 2), (2, None, "setup", 1, 3))
    f = forest.snapshot(events, frame(spark, "owner long, chapter long", (1, 1), (3, 2)), parents, relations, proof, actions, 2)
    nodes = {r["event_id"]: r for r in f.nodes.collect()}
    assert {i: (r["tree_id"], r["cause_role"], r["event_ordinal"]) for i, r in nodes.items()} == {1: (1, "root", 0), 2: (1, "main", 1), 3: (3, "root", 2)}  # a parent of another chapter is none
    assert [r["relation_id"] for r in f.edges.collect()] == [8]
    assert sorted((r["root_event_id"], r["status"], r["payoff_event_id"]) for r in f.threads.collect()) == [(1, "likely_paid_off", 3), (2, "open", None)]
    early = forest.snapshot(events, none("owner long, chapter long"), parents, relations, proof, actions, 1)
    assert sorted((r["root_event_id"], r["status"]) for r in early.threads.collect()) == [(1, "open"), (2, "open")]
    with pytest.raises(ValueError):
        forest.snapshot(events, frame(spark, "owner long, chapter long", (1, 2)), parents, relations, proof, actions, 2)
