"""Literals and properties of the plain functions."""

import random

import numpy as np
import pytest

from storyspark.functions import cjk, series
from storyspark.operators import graph_algorithms as G

from sequential_louvain import louvain_labels


@pytest.mark.parametrize("text,value", [("二百五", 250), ("一百零五", 105), ("十二", 12), ("一万二", 12000), ("三千零五十", 3050), ("一亿二千万", 120000000), ("二〇二四", 2024), ("12", 12), ("abc", None), ("", None), ("万万", 100000000), ("一百○八", 108), ("万", 10000), ("十二万三千", 123000), ("一万二千五", 12500), ("一万〇一", 10001), ("一〇〇八", 1008), ("一千〇十", 1010), ("一千〇二三", 1023), ("〇五", 5), ("一〇八万", 1080000), ("三百二十一万四千五百六十七", 3214567), ("一亿零五万", 100050000), ("一万亿", 10**12), ("二十亿零三万", 2000030000), ("两", 2), ("１２", 12)])
def test_numeral(text, value):
    assert cjk.numeral(text) == value


def test_spans():
    assert cjk.dialogue_spans("他说「你好『内』」。“未完\n下") == [(2, 9, True), (10, 13, False)]
    assert cjk.dialogue_spans('a "b" «c "d"» "e') == [(2, 5, True), (6, 13, True), (14, 16, False)]
    assert [t for *_, t in cjk.term_spans("abcabab", ["ab", "abc"])] == ["abc", "ab", "ab"]
    assert cjk.sentiment("not good, she said again, good", ["good"], ["bad"]) == (1, 1)
    flips = {"not good": True, "it is not very good": True, "it is not at all good": False, "not in the least good": True, "not here, in a way good": False, "never not good": False, "I know good": False, "not bad! good": False}
    assert {t: cjk.negated(t, t.rfind("good")) for t in flips} == flips
    assert cjk.negated("他不得不高兴", 4) is False and cjk.negated("未必高兴", 2) is False and cjk.negated("舍不得这里的高兴", 6) is False and cjk.negated("舍不得离开这里", 5) is True
    spec = cjk.negation_spec(["# ===== hard =====", "nay", "# a note", "nay", "# ===== modal words =====", "maybe", "# ===== other =====", "x"])
    assert spec == {"hard": ("nay",), "modal": ("maybe",), "double": (), "scope": ()} and cjk.negated("nay good", 4, spec)
    assert cjk.nth_quote("aXaXa", "aXa", 2) == (2, 5)
    with pytest.raises(ValueError):
        cjk.nth_quote("abc", "x")
    assert cjk.preprocess(cjk.preprocess("a\r\n\r\n\r\nb")) == cjk.preprocess("a\r\n\r\n\r\nb") == "a\n\nb"
    assert cjk.decode("中文".encode("gb18030")) == "中文"


def test_lowess():
    x = np.linspace(0, 1, 40)
    assert np.allclose(series.lowess(x, 2 * x + 1), 2 * x + 1)
    assert series.lowess([0, 1], [5, 7]).tolist() == [5, 7]
    y = np.ones(40)
    y[20] = 50
    assert abs(series.lowess(x, y, bandwidth=0.3)[20] - 1) < 0.1
    with pytest.raises(ValueError):
        series.lowess(x, x, bandwidth=0)
    assert series.smooth_nullable([0, 1, 2], [1.0, None, 3.0])[1] is None


def test_sampling_and_phases():
    y = np.sin(np.arange(200) / 9)
    kept = series.lttb(y, 20)
    assert kept[0] == 0 and kept[-1] == 199 and kept == sorted(set(kept)) and len(kept) == 20
    assert {7, 11} <= set(series.sample_curve(y.tolist(), 20, [7, 11]))
    assert [a for a, *_ in series.four_phases(list(range(3)))] == ["opening"]
    for n in (6, 19, 50):
        p = series.four_phases(list(np.sin(np.arange(n))))
        assert p[0][1] == 0 and p[-1][2] == n - 1 and all(b[1] == a[2] + 1 for a, b in zip(p, p[1:]))
    acts = series.three_acts(np.arange(50), y[:50])
    assert abs(sum(acts[k] for k in ("setup", "confrontation", "resolution")) - 1) < 1e-3
    assert series.three_acts([1, 1, 2] * 5, y[:15]) is None and series.three_acts([0, 1], [1, 2])["setup"] == 0.3333
    # a step up in tension and flags at 40 ends the set-up; the window with the conflict wins over a tenser one
    steps, marks, fights = np.r_[np.full(40, 0.1), np.full(60, 0.5)], np.r_[np.zeros(40), np.ones(60)], np.zeros(100)
    steps[70], steps[90], fights[91] = 0.9, 0.7, 1
    acts = series.three_acts(np.arange(100), steps, fights, marks)
    assert acts["climax"] == round(90 / 99, 4)
    flat = series.three_acts(np.arange(100), steps)
    assert flat["climax"] == round(70 / 99, 4) and flat["setup"] < 0.06  # no flags: the valley before the climax
    acts = series.three_acts(np.arange(100), np.r_[np.full(40, 0.1), np.full(60, 0.5)], np.r_[np.zeros(80), np.ones(8), np.zeros(12)], marks)
    assert acts["setup"] == round(40 / 99, 4) or abs(acts["setup"] - 40 / 99) < 0.03
    assert series.mtld(["a"] * 3) is not None and series.mtld(["a", "b"]) is None and series.mtld([]) == 0
    assert abs(series.mtld(list("abcdefga")) - 8 / ((1 - 7 / 8) / 0.28)) < 1e-9
    assert series.lttb([1, 5, 2, 9], 2) == [0, 3] and series.lttb([1, 2], 2) == [0, 1] and series.lttb([], 5) == []
    spike = [0.0] * 50
    spike[23] = 7.0
    assert 23 in series.lttb(spike, 10)
    m = series.monotone([0.1, 0.1, 0.05, 0.5])
    assert all(b > a for a, b in zip(m, m[1:]))


def test_graphs(spark):
    two = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.1)], "a long, b long, w double")
    labels = louvain_labels(*zip(*[(r.a, r.b, r.w) for r in two.collect()]))
    assert labels[1] == labels[2] == labels[3] != labels[4] == labels[5] == labels[6]
    ranks = {r["node"]: r["rank"] for r in G.pagerank(two).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks[3] > ranks[1]
    assert {r["component"] for r in G.components(two).collect()} == {1}
    same = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    different = spark.createDataFrame([(1, 3)], "a long, b long")
    preferred = spark.createDataFrame([(8,)], "node long")
    got = {r["node"]: r["representative"] for r in G.identity_components(same, different, preferred).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 7: 8, 8: 8}
    assert not G.acyclic(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")) and G.acyclic(same)


def test_sources(spark, tmp_path):
    from storyspark.sources import files

    (tmp_path / "b.txt").write_bytes("中文书".encode("gb18030"))
    (tmp_path / "a.txt").write_text("plain")
    assert sorted(r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()) == ["plain", "中文书"]
    (tmp_path / "lex").write_text("# head\n# ===== 1. joy =====\nglad  # note\nglad\nhappy\tx\n# ===== 2. other =====\nzzz\n")
    assert [r["term"] for r in files.read_lexicon(spark, str(tmp_path / "lex")).orderBy("ord").collect()] == ["glad", "happy", "zzz"]
    assert {r["category"] for r in files.read_sectioned_lexicon(spark, str(tmp_path / "lex"), {"joy": "pos"}).collect()} == {"pos"}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, files.upserted(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        files.inserted(old, new, ["id"])
    with pytest.raises(ValueError):
        files.validated_topics(spark.createDataFrame([(1, 0, 0.4)], "paragraph_id int, topic_id int, topic_weight double"), 2)


def test_running(spark):
    from pyspark.sql import functions as F

    from storyspark.operators import ordering

    df = spark.createDataFrame([(i, (i * 37) % 101, None if i % 9 == 0 else i % 7) for i in range(101)], "id int, v int, w long")
    got = {r["id"]: (r["rn"], r["s"]) for r in ordering.running(ordering.numbered(df, [F.col("v")]), [F.col("v")], "s", F.col("w")).collect()}
    total = 0
    for n, r in enumerate(sorted(df.collect(), key=lambda r: r["v"]), 1):
        total += r["w"] or 0
        assert got[r["id"]] == (n, total)
    assert ordering.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_stream_equals_batch(spark):
    from storyspark.operators import custom

    SF = "/root/testdata/sf0.001"
    assert sorted(map(str, custom.outbox_stream(spark, SF).collect())) == sorted(map(str, custom.outbox_projection(spark, SF).collect()))


def test_textrank_is_pagerank_of_pairs(spark):
    rng = random.Random(5)
    texts = [[rng.choice("aabcdefgh") for _ in range(rng.randrange(1, 30))] for _ in range(12)] + [["z"], ["y", "y", "y"], []]
    pairs = {}
    for t in texts:
        for i, x in enumerate(t):
            for step, y in enumerate(t[i + 1 : i + 5], 1):
                if x != y:
                    key = (min(x, y), max(x, y))
                    pairs[key] = pairs.get(key, 0.0) + 5 - step
    want = {r["node"]: r["rank"] for r in G.pagerank(spark.createDataFrame([(*k, w) for k, w in pairs.items()], "a string, b string, w double"), most=20).collect()}
    rows = spark.createDataFrame([(d, i, x) for d, t in enumerate(texts) for i, x in enumerate(t)], "doc_id long, i int, tk string")
    got = {r["node"]: r["rank"] for r in G.textrank(rows, most=20).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert G.textrank(rows.limit(0)).count() == 0
