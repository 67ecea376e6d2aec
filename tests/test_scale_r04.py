"""Rows that hang on the last digit of a sum, and work that a larger corpus brings."""

import duckdb

from storyspark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def test_importance_halfway_between_two_hundredths(spark, tmp_path):
    """0.565 is 0.56 as a double; users without values come last, a user's values are added in the order of events."""
    rows = [(u, [47.5] * 70) for u in (3, 5)] + [(u, [x] * n) for u, x, n in ((1, 42.5, 55), (2, 10.0, 30), (4, 99.9, 40), (6, None, 3), (7, None, 2), (8, 1.0, 500))]
    rows += [(u, [0.1 * ((i * 37 + u) % 700) for i in range(70)]) for u in range(20, 60)]
    events = [(u, v) for i in range(500) for u, values in rows for v in values[i : i + 1]]
    spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(events)], "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in QUERIES["event_timeline_levels"](spark, str(tmp_path)).select("user_id", "importance", "level").collect())
    c = duckdb.connect(config={"threads": 1})  # with more threads DuckDB adds the values in any order
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(c.sql(f"select user_id, importance, level from ({ORACLES['event_timeline_levels']})").fetchall())
    assert [r[1] for r in got if r[0] in (3, 5)] == [0.56, 0.56]


def test_deviation_of_chapters_to_the_last_digit(spark, tmp_path):
    """chapters of few distinct values lie on thresholds; Spark's own stddev_samp puts some of them on the other side."""
    shapes = [((2, 20), (1, 80), (1, 80), (1, 80)), ((2, 74), (-2, 100), (-2, 100), (-2, 100)), ((-1, 10), (-1, 10), (1, 80), (-1, 10)), ((-1, 100), (-1, 100), (1, 84), (-1, 100)), ((-1, 100), (-1, 100), (2, 100), (-1, 100)), ((1, 50), (0, 50), (0, 50), (0, 50)), ((1, 40),), ((0, 30), (2, 30))]
    chapter = lambda net, n: "\n".join([" ".join(["the" if net > 0 else "of"] * abs(net) + ["x"] * (n - abs(net) - 4)), *"xxxx"])
    texts = [*("\n".join(chapter(*c) for c in shape) for shape in shapes), "", None, "\n \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(tuple(r) for r in QUERIES["recovery_speed"](spark, str(tmp_path)).select("doc_id", "recoveries", "mean_chapters").collect())
    c = duckdb.connect(config={"threads": 1})  # with more threads DuckDB adds the chapters in any order
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == sorted(c.sql(f"select doc_id, recoveries, mean_chapters from ({ORACLES['recovery_speed']})").fetchall())


def test_word_vectors_learn_from_runs_of_tokens(spark, tmp_path, monkeypatch):
    """no training pair by pair, unless the vocabulary is too large to be broadcast; all words of two occurrences have a vector."""
    from storyspark.operators import learning, skipgram

    texts = ["Aa bb cc 12 x 中文 bb", "aa BB once dd", None, "", "dd 12 中文"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = learning.fit_word2vec
    monkeypatch.setattr(learning, "fit_word2vec", None)
    words = lambda: {r["word"]: len(r["vector"]) for r in QUERIES["word2vec"](spark, str(tmp_path)).collect()}
    assert words() == dict.fromkeys(("aa", "bb", "12", "dd", "中文"), 16)
    monkeypatch.setattr(learning, "fit_word2vec", plain)
    monkeypatch.setattr(skipgram, "MODEL_BYTES", 10)
    assert words() == dict.fromkeys(("aa", "bb", "12", "dd", "中文"), 16)


def test_step_has_all_pairs_and_their_gradients():
    """one step on a run is what its pairs ask for one by one; a negative that is the context does not count."""
    import numpy as np

    from storyspark.operators import skipgram

    rng, window, n_words = np.random.default_rng(3), 3, 40
    ids, doc = rng.integers(0, n_words, 32), np.repeat([0, 1, 2], [20, 2, 10])
    w_in, w_out = (rng.normal(size=(n_words, 4)).astype(np.float32) for _ in range(2))
    drawn = rng.integers(0, n_words, (2, 2 * window * 5))
    a, b = skipgram.pairs(np.arange(32), doc, window)
    d_in, d_out = np.zeros((n_words, 4)), np.zeros((n_words, 4))
    pull = lambda s: 1 / (1 + np.exp(s))
    for i, j in zip(a, b):
        x, y = w_in[ids[i]], w_out[ids[j]]
        d_in[ids[i]] += pull(x @ y) * y
        d_out[ids[j]] += pull(x @ y) * x
        for m in drawn[i // skipgram.GROUP]:
            if m != ids[j]:
                d_in[ids[i]] -= pull(-x @ w_out[m]) * w_out[m] / (2 * window)
                d_out[m] -= pull(-x @ w_out[m]) * x / (2 * window)
    got_in, got_out, often = w_in.copy(), w_out.copy(), np.zeros(n_words, np.float32)
    steps, skipgram.STEPS = skipgram.STEPS, 1e9
    _, n, _, _ = skipgram._learn(got_in, got_out, np.pad(ids, window), np.pad(doc, window, constant_values=-1), drawn, window, 0.1, often)
    skipgram.STEPS = steps
    assert n == len(a) and not often.any()
    assert np.allclose(got_in - w_in, 0.1 * d_in, atol=1e-4) and np.allclose(got_out - w_out, 0.1 * d_out, atol=1e-4)


def test_textrank_of_whole_texts(spark, tmp_path, monkeypatch):
    """short words count too, rounds go on until the ranks stand, and the three ways to them agree."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from storyspark.operators import graph_algorithms as G

    rng = random.Random(4)
    texts = [" ".join(rng.choice(("aa", "bb", "Cc", "dd", "longerword", "x", "中文", "ee")) for _ in range(rng.randrange(1, 40))) for _ in range(30)] + ["", None, "aa", "ff ff"]
    spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    split = [[w for w in (t or "").split(" ") if len(w) > 1] for t in texts]
    want = {r["node"]: r["rank"] for r in G.textrank(spark.createDataFrame([(d, i, w) for d, t in enumerate(split) for i, w in enumerate(t)], "doc_id long, i int, tk string")).collect()}
    top = QUERIES["textrank"](spark, str(tmp_path)).collect()
    assert {r["node"]: r["rank"] for r in top} == {k: round(v, 6) for k, v in want.items()} and len(top) == 7
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(G, "RANKS", 3)
    got = {r["node"]: r["rank"] for r in G.textrank_texts(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    ids, doc, value = np.array([0, 1, 1, 2, 0, 1, 2, 3]), np.array([0, 0, 0, 0, 1, 1, 1, 1]), np.array([1.0, 2.0, 4.0, 8.0])
    whole = G._around(ids, doc, value, 4)
    monkeypatch.setattr(G, "PLACES", 2)
    assert np.allclose(G._around(ids, doc, value, 4), whole)
    monkeypatch.setattr(G, "RANKS", 100)
    assert G.textrank_texts(docs.where(F.lit(False))).count() == 0
