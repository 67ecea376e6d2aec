"""Word vectors that start from given ones; topic models that are saved and loaded."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.operators import learning, skipgram


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    topics = [[f"{t}{i}" for i in range(8)] for t in "xyz"]
    rows = [([rng.choice(rng.choice(topics) if rng.random() < 0.05 else topics[k % 3]) for _ in range(25)],) for k in range(240)]
    return spark.createDataFrame([*rows, ([],), (None,), (["once"],)], "tokens array<string>")


def table(trained):
    return {r["word"]: np.array(r["vector"]) for r in trained.vectors.collect()}


def near(v, a, b):
    return v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])


def test_warm_start(spark, docs):
    cold = skipgram.train(docs, 12, epochs=12)
    v = table(cold)
    assert cold.vocabulary == 24 and "once" not in v and cold.known == 0 and len(cold.losses) == 12 and cold.losses[-1] < cold.losses[0]
    assert np.mean([near(v, "x0", f"x{i}") for i in range(1, 8)]) > np.mean([near(v, "x0", f"y{i}") for i in range(8)]) + 0.3
    given = cold.vectors.select("word", "vector").where("word not in ('x0', 'y0')").union(spark.createDataFrame([("stranger", [1.0] * 12)], "word string, vector array<double>"))
    start = skipgram.train(docs, 12, given, epochs=0)
    w = table(start)
    assert start.known == 22 and all(np.allclose(w[x], v[x]) for x in v if x not in ("x0", "y0")) and not np.allclose(w["x0"], v["x0"]) and "stranger" not in w
    warm, scratch = skipgram.train(docs, 12, given, epochs=1), skipgram.train(docs, 12, epochs=1)
    assert warm.losses[0] < scratch.losses[0]
    assert all(not np.allclose(table(warm)[x], v[x]) for x in ("x1", "x0"))  # all words are trained on


def test_odd_training(spark, docs, monkeypatch):
    assert skipgram.train(docs.where("size(tokens) = 1"), 4).vectors.count() == 0
    with pytest.raises(ValueError):
        skipgram.train(docs, 4, spark.createDataFrame([("x1", [1.0])], "word string, vector array<double>"))
    monkeypatch.setattr(skipgram, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        skipgram.train(docs, 4)


def test_pairs():
    a, b = skipgram.pairs(np.array([1, 2, 3, 4]), np.array([0, 0, 0, 1]), 2)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_topic_model_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/model"
    words, model = learning.fit_lda(docs, k=3)
    learning.save_topic_model(spark, path, words, model, {1: "letters"})
    other = spark.newSession()
    got = learning.load_topic_model(other, path)
    assert got.reason is None and got.labels == {1: "letters"} and got.words.vocabulary == words.vocabulary
    rounded = lambda m, w: sorted(str((r["status"], r["n_tokens"], [round(x, 6) for x in r["weights"]])) for r in learning.infer_lda(docs.where("tokens is not null"), w, m).select("status", "n_tokens", "weights").collect())
    assert rounded(got.model, got.words) == rounded(model, words)
    assert learning.load_topic_model(spark, f"{path}-none").reason.startswith("topic_model_artifact_missing")
    learning.save_topic_model(spark, f"{path}2", learning.fit_lda(docs.select(F.array(F.lit("a")).alias("tokens")), k=2)[0], model)
    assert learning.load_topic_model(spark, f"{path}2").reason.startswith("topic_model_load_failed")
    (tmp_path / "model2" / "words" / "metadata").rename(tmp_path / "model2" / "gone")
    broken = learning.load_topic_model(spark, f"{path}2")
    assert broken.reason.startswith("topic_model_load_failed") and broken.model is None
