"""topic models count words and make bags on the bytes of many texts at once, and read texts no more than they must."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from storyspark.functions import words
from storyspark.operators import custom, learning
from storyspark.plans.dialect import TOKEN

ODD = ["the the2 _the_ theé", None, "", "的the的 of 中文", "䷿一丁鿿鿿ꀀꀀ ䷿ a bb", "x", "ab", "cd", "中", "中文", "ééé", "K the ıl", "😀ab😀", "end中文"]


@pytest.mark.parametrize("block", [7, 1 << 23])
def test_words_of_bytes(monkeypatch, block):
    """As the pattern finds them: at borders of kinds, rows and blocks, and in slices of columns."""
    monkeypatch.setattr(words, "BLOCK", block)
    rng = random.Random(1)
    rows = ODD + ["".join(rng.choice("aZ09 é中文䷿ꀀ😀_\n") for _ in range(rng.randrange(30))) for _ in range(500)]
    for col in (pa.array(rows), pa.array(["zz yy", *rows]).slice(1), pa.array(rows, pa.large_string())):
        got = []
        for found, sizes in words.words(col):
            found.validate(full=True)
            flat = iter(found.to_pylist())
            got += [[next(flat) for _ in range(n)] for n in sizes]
        assert got == [[t for t in re.findall(TOKEN, r or "") if len(t) >= 2] for r in rows]


@pytest.mark.parametrize("held", [2, 1 << 19])
def test_counts_and_bags(monkeypatch, held):
    """Counts that are handed on early add up; bags of arrays with nulls, of unknown words and without a vocabulary."""
    monkeypatch.setattr(words, "HELD", held)
    rows = [["a", None, "b", "a"], None, [], ["c"]]
    batches = [pa.record_batch([pa.array(rows)], ["t"])] * 3
    got = Counter()
    for b in words.counts(iter(batches)):
        got.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist())))
    assert got == {"a": 6, "b": 3, "c": 3}
    bag = words.bags(pa.array(rows), pa.array(["c", "a"])).to_pylist()
    assert [(b["n_all"], b["n_tokens"], b["bow"]["indices"], b["bow"]["values"]) for b in bag] == [(4, 2, [1], [2.0]), (0, 0, [], []), (0, 0, [], []), (1, 1, [0], [1.0])]
    assert [b["n_tokens"] for b in words.bags(pa.array(rows), pa.array([], pa.string())).to_pylist()] == [0] * 4
    assert len(words.bags(pa.array([], pa.string()), pa.array(["a"]))) == 0


def test_bags_are_those_of_spark_ml(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for t in ODD if t)], "doc_id long, text string").withColumn("tokens", F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) >= 2))
    mine, theirs = learning.dictionary(docs, "text"), CountVectorizer(inputCol="tokens", outputCol="bow").fit(docs)
    assert sorted(mine.vocabulary) == sorted(theirs.vocabulary)
    for column in ("text", "tokens"):
        got = {r["doc_id"]: r for r in learning.bags(docs, mine, column).collect()}
        for r in theirs.transform(docs).collect():
            named = lambda v, names: {names[i]: x for i, x in zip(v.indices, v.values)}
            assert named(got[r["doc_id"]]["bow"], mine.vocabulary) == named(r["bow"], theirs.vocabulary) and got[r["doc_id"]]["n_all"] == got[r["doc_id"]]["n_tokens"] == len(r["tokens"])


def test_dictionary_of_ties(spark):
    """The most frequent words, ties by the word, whatever the partitions."""
    docs = spark.createDataFrame([(w,) for w in "dd cc bb aa zz zz".split()], "tokens string")
    assert {tuple(sorted(learning.dictionary(docs.repartition(n), vocabulary=3).vocabulary)) for n in (1, 3, 5)} == {("aa", "bb", "zz")}


@pytest.mark.parametrize("query", ["lda_topics", "topic_model_artifact"])
def test_topics_of_odd_texts(spark, tmp_path, query):
    """Null and empty texts, and texts without words, have weights of zero; the others' sum to 1."""
    texts = ["Alpha beta gamma", "beta BETA delta 中文", "! a b ?", "", None] * 8
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in getattr(custom, query)(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(40))
    for i, t in enumerate(texts):
        n = 3 if i % 5 == 0 else 4 if i % 5 == 1 else 0
        assert (rows[i]["status"], rows[i]["n_tokens"]) == ("ok" if n else "empty", n) and sum(rows[i]["weights"]) == pytest.approx(1 if n else 0, abs=1e-5)


def test_topics_read_texts_twice(spark, tmp_path, monkeypatch):
    """One pass counts words, one makes the bags, which are a table from then on."""
    spark.createDataFrame([(i, f"alpha beta w{i % 7} gamma") for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.sparkContext.accumulator(0)
    texts = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = F.udf(lambda t: read.add(1) or t, "string").asNondeterministic()
    monkeypatch.setattr(custom, "_documents", lambda spark, sf_dir, *cols: texts.withColumn("text", seen("text")).select("doc_id", *cols))
    assert len(custom.lda_topics(spark, str(tmp_path)).collect()) == 60 and read.value == 120
