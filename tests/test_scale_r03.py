"""What larger tables bring: long sentences, many messages of one run, many partitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from storyspark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def _same(spark, folder, name):
    """Spark's rows of a query on the tables of a folder, which must be those of its SQL."""
    c = duckdb.connect()
    for table in folder.glob("*.parquet"):
        c.sql(f"create view {table.stem} as select * from read_parquet('{table}{'/*.parquet' if table.is_dir() else ''}')")
    got = QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    tidy = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    rows = tidy(tuple(r) for r in got.select(columns).collect())
    assert rows == tidy(c.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    return rows


@pytest.mark.parametrize("name", ["sentence_len_stats", "chapter_summary", "book_summary", "book_statistics"])
def test_sentence_whose_square_is_beyond_32_bits(spark, tmp_path, name):
    """60,000 characters without a sentence's end."""
    text = "alpha beta the " * 4000
    spark.createDataFrame([(1, text + "! of la.\nshort"), (2, "a b! c"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert _same(spark, tmp_path, name)


ODD = ["The THE the2 _the_ theé é-the der\nOf.LA, und?los! st；eux、ge，rr ！？。!? x", "!!!\n？a？\n...\n的the的 of", "ſt K the ıl ELK el İel of", "", " \n ", None, "no end", "a!b！c？d。e?f"]


@pytest.mark.parametrize("name", ["paragraph_metrics", "chapter_sums", "ttr_by_chapter", "punctuation_density"])
def test_counters_on_odd_texts(spark, tmp_path, name):
    """marks, words at all kinds of borders, chapters of several paragraphs."""
    rows = [(i, t) for i, t in enumerate([*ODD, "\n".join(t for t in ODD if t) * 3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _same(spark, tmp_path, name)


def test_paragraph_counters_without_slow_steps(spark, tmp_path):
    """no negated class over wide characters, no row a token before a chapter's tokens are counted."""
    from storyspark.operators import text_metrics
    from storyspark.plans.dialect import Dialect

    d = Dialect("spark", str(tmp_path))
    assert "[^。" not in d.paragraphs() and "translate(" not in d.paragraphs()
    assert "posexplode(toks)" not in text_metrics.QUERIES["ttr_by_chapter"](d)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_of_runs_longer_than_an_arrow_batch(spark, tmp_path, files):
    """a run's messages come in several frames of any order, and the table may be a folder of files."""
    rows = spark.range(40_000).select(((F.col("id") * 7919) % 40_000).alias("event_id"), (F.col("id") % 2).alias("user_id"))
    rows = rows.select("event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("ts"), "user_id", F.concat(F.lit("e"), F.col("event_id") % 13).alias("event_type"))
    at = tmp_path / "events.parquet"
    if files == 1:
        rows.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(at)
    else:
        rows.repartition(files).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(at))
    assert len(_same(spark, tmp_path, "outbox_stream")) == 2


def test_fold_of_frames():
    """frames in any order, repeats, messages before the cursor and empty texts."""
    import numpy as np
    import pandas as pd

    from storyspark.streaming.outbox import TAIL, fold

    rng = np.random.default_rng(1)
    seqs = rng.permutation(np.repeat(np.arange(3000), 2))
    text = lambda i: None if i % 50 == 0 else f"{i};"
    frames = [pd.DataFrame({"seq": part, "text": [text(i) for i in part]}) for part in np.array_split(seqs, 17)]
    want = "start" + "".join(text(i) or "" for i in range(100, 3000))
    assert fold((99, 5, "start"), frames) == (2999, 2905, want[-TAIL:])
    assert fold((9999, 5, "start"), frames) == (9999, 5, "start") and fold((-1, 0, ""), []) == (-1, 0, "")


def test_word_vectors_are_trained_by_many_tasks(spark, monkeypatch):
    """however few files hold the documents, and close words stay close when tasks are averaged."""
    import numpy as np

    from storyspark.operators import learning, skipgram

    docs = spark.range(600).select(F.array_repeat(F.concat(F.lit("a"), F.col("id") % 2), 1).alias("x"), "id").select(F.when(F.col("id") % 2 == 0, F.split(F.lit("p q r s p q r s"), " ")).otherwise(F.split(F.lit("t u v w t u v w"), " ")).alias("tokens")).coalesce(1)
    given = {}
    ml = learning.Word2Vec
    monkeypatch.setattr(learning, "Word2Vec", lambda **kw: ml(**(given.update(kw) or kw)))
    monkeypatch.setattr(learning, "TASK_TOKENS", 1000)
    assert {r["word"] for r in learning.fit_word2vec(docs, size=4).collect()} == set("pqrstuvw") and given["numPartitions"] == 5
    monkeypatch.setattr(skipgram, "TASK_TOKENS", 1000)
    tasks = []
    deal = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *c: tasks.append(n) or deal(self, n, *c))
    out = skipgram.train(docs, 8, epochs=6)
    assert tasks == [4] and out.losses[-1] < out.losses[0]
    v = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in out.vectors.collect()}
    assert v["p"] @ v["q"] > v["p"] @ v["u"] and v["t"] @ v["w"] > v["t"] @ v["s"]


def test_sentiment_looks_back_once_a_sentence(monkeypatch):
    """the sentence's start is not sought back through the whole text for each hit, and tokens only where one-letter terms ask."""
    from storyspark.functions import cjk

    text = "not the a. never the b! no, the c\nnot un the d 的 the 没 the x" * 3
    want = [sum(x) for x in zip(*[(0, 1) if cjk.negated(text, s) else (1, 0) for s, _, _ in cjk.term_spans(text, [" the "])])]
    assert list(cjk.sentiment(text, [" the "], [])) == want and want[0] and want[1]
    monkeypatch.setattr(cjk, "negated", lambda text, start, negators=None, begin=None: begin is None)
    assert cjk.sentiment(text, [" the "], []) == (len(cjk.term_spans(text, [" the "])), 0)
    assert [x[:2] for x in cjk.term_spans("a bab a", ["a"])] == [(0, 1), (6, 7)] and len(cjk.term_spans("bab", ["a"], letters=True)) == 1


def test_emotion_spans_keep_few_texts_as_objects(spark, monkeypatch):
    """spans of some texts at a time, in batches that are theirs; ids stay with their spans."""
    from storyspark.functions import spans

    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("the cat of "), F.repeat(F.lit("the "), (F.col("id") % 5).cast("int")))).alias("text")).coalesce(1)
    out = spans.emotion_spans(docs, ["the", "of"], "[A-Za-z0-9]+")
    got = out.groupBy("doc_id", "term").count().collect()
    assert {(r["doc_id"], r["term"]): r["count"] for r in got} == {(i, t): (1 + i % 5 if t == "the" else 1) for i in range(700) if i % 3 for t in ("the", "of")}
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString() and spans.TEXTS < 700


def test_cooccurrence_without_a_shuffle_of_tokens(spark, tmp_path):
    """one shuffle, that of the pairs; short, null and repeating texts."""
    texts = ["aa bb cc dd ee ff aa bb", "aa aa aa aa aa", "aa bb cc dd", None, "", "x yy z aa bb cc 中文 dd", "aa bb cc dd ee"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert _same(spark, tmp_path, "cooccurrence")
    assert "Window" not in QUERIES["cooccurrence"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_on_a_threshold(spark, tmp_path):
    """F8: three equal chapters and a fourth lie on a threshold, where the last digit of the sums decides; equal texts get equal rows."""
    shapes = [((0, 134), (0, 155), (0, 155), (1, 44)), ((2, 83), (0, 117), (0, 178), (0, 27)), ((-2, 168), (0, 186), (5, 370), (1, 10))]
    chapter = lambda net, n: "\n".join([" ".join(["the" if net > 0 else "of"] * abs(net) + ["x"] * (n - abs(net) - 4)), *"xxxx"])
    texts = ["\n".join(chapter(*c) for c in shape) for shape in shapes]
    spark.createDataFrame([(i, texts[i % 3]) for i in range(180)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in QUERIES["recovery_speed"](spark, str(tmp_path)).select("doc_id", "recoveries", "mean_chapters").orderBy("doc_id").collect()]
    assert [len({r[1:] for r in rows if r[0] % 3 == k}) for k in range(3)] == [1, 1, 1]
    c = duckdb.connect(config={"threads": 1})  # with more threads DuckDB adds the chapters in any order
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows == c.sql(f"select doc_id, recoveries, mean_chapters from ({ORACLES['recovery_speed']}) order by doc_id").fetchall()
