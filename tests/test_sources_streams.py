"""Word-list registry, sinks and streams that no query runs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from storyspark.functions import spans
from storyspark.sources import files, lexicons
from storyspark.streaming import outbox


def test_lexicon_registry(spark, tmp_path, monkeypatch):
    (tmp_path / "good.txt").write_text("happy\n# a note\nglad  # inline\nhappy\n\nvery glad\tnote\n", encoding="utf-8")
    (tmp_path / "bad.txt").write_text("sad\n", encoding="utf-8")
    (tmp_path / "none.txt").write_text("# nothing\n", encoding="utf-8")
    names = {"positive": "good.txt", "negative": "bad.txt", "empty": "none.txt"}
    with pytest.raises(FileNotFoundError, match="lost"):
        lexicons.Registry(spark, f"file://{tmp_path}", {**names, "lost": "gone.txt"})
    r = lexicons.Registry(spark, f"file://{tmp_path}", names)
    assert [x["term"] for x in r.terms("positive").orderBy("ord").collect()] == ["happy", "glad", "very glad"] and r.terms("positive") is r.terms("positive")
    assert sorted(map(tuple, r.catalogue().collect())) == [("empty", "none.txt", 0), ("negative", "bad.txt", 1), ("positive", "good.txt", 3)]
    a = r.automaton("positive", "negative", "empty")
    assert a.terms == ["glad", "happy", "sad", "very glad"] and spans.locate("so very glad", ["so", "very", "glad"], a) == [(3, 12, "very glad")]
    with pytest.raises(KeyError):
        r.terms("other")
    monkeypatch.setattr(spans, "LEXICON_BYTES", 5)
    with pytest.raises(ValueError):
        r.automaton("positive")
    r.close()


def test_overwrite_runs(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "run_id int, code string, v int"
    files.overwrite_runs(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], schema), path, "run_id", "code")
    files.overwrite_runs(spark.createDataFrame([(1, "b", 9), (1, "b", 8)], schema), path, "run_id", "code")
    assert sorted((r["run_id"], r["code"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a", 1), (1, "b", 8), (1, "b", 9), (2, "a", 3)]
    files.overwrite_runs(spark.createDataFrame([], schema), path, "run_id", "code")
    assert spark.read.parquet(path).count() == 4


def test_export_json(spark, tmp_path):
    path = f"{tmp_path}/out"
    a = spark.createDataFrame([(1, "x"), (1, None), (2, "y")], "run int, v string")
    b = spark.createDataFrame([(1, 5)], "run int, n int")
    files.export_json({"a": a, "b": b}, F.col("run"), f"file://{path}")
    docs = {d["key"]: d for d in (json.loads(r["value"]) for r in spark.read.text(f"file://{path}").collect())}
    assert docs[1]["b"] == [{"run": 1, "n": 5}] and sorted(map(str, docs[1]["a"])) == sorted(map(str, [{"run": 1, "v": "x"}, {"run": 1}])) and "b" not in docs[2]


def test_idempotent_replay_sessions(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=m)
    rows = [(1, 1, "a", t(0)), (1, 2, "b", t(5)), (1, 2, "b", t(6)), (1, 3, "c", t(90)), (2, 1, "a", t(1))]
    schema = "run_id int, seq int, message_key string, ts timestamp"
    log = spark.createDataFrame(rows, schema)
    keys = lambda df: sorted((r["run_id"], r["message_key"]) for r in df.collect())
    want = [(1, "a"), (1, "b"), (1, "c"), (2, "a")]
    assert keys(outbox.idempotent(log)) == want
    assert [r["seq"] for r in outbox.replay(log.where("run_id = 1").dropDuplicates(["seq"]), 1, page=1).collect()] == [2]
    assert sorted((r["run_id"], r["messages"]) for r in outbox.idle_sessions(log).collect()) == [(1, 1), (1, 3), (2, 1)]
    log.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = outbox.idempotent(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert keys(spark.read.parquet(f"file://{tmp_path}/out")) == want
