"""The durable consumer over restarts and failures; contributions over replays and changes."""

import pytest
from pyspark.sql import functions as F

from storyspark.sources import contributions
from storyspark.streaming import subscription

SCHEMA = "run_id long, seq long, message_key string, text string"


def plain(rows, tail=8192):
    out = {}
    for run, seq, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        last, n, t = out.get(run, (-1, 0, ""))
        if seq > last:
            out[run] = (seq, n + 1, (t + (text or ""))[-tail:])
    return out


def snapshot_of(df):
    return {r["run_id"]: (r["last_seq"], r["messages"], r["tail"]) for r in df.collect()}


def test_restart_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    inbox, folder = f"{tmp_path}/inbox", f"file://{tmp_path}/sink"
    files = [[(1, 1, "a", "x;"), (1, 2, "b", "y;"), (2, 1, "c", None)], [(1, 2, "b", "y;"), (1, 3, "d", "z;" * 5000), (3, 1, "e", "")], [(2, 2, "f", "q;"), (1, 4, "g", "w;"), (1, 3, "d", "z;" * 5000)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{inbox}/{i}")
    stream = lambda upto: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{inbox}/[0-{upto}]")
    whole, broken = subscription.folded, []

    def breaks_once(state, messages, *a):
        if not broken:
            broken.append(1)
            raise OSError("the machine is gone")
        return whole(state, messages, *a)

    monkeypatch.setattr(subscription, "folded", breaks_once)
    with pytest.raises(Exception):
        subscription.consume(stream(2), folder).awaitTermination()
    # the first batch's messages are written but not marked: no reader sees them
    snapshot, cut = subscription.connect(spark, folder)
    assert cut is None and snapshot.count() == 0 and subscription.deltas(spark, folder, None).count() == 0
    subscription.consume(stream(2), folder).awaitTermination()
    seen = {r[2]: r for rows in files for r in rows}
    log = spark.read.parquet(f"{folder}/log").select("run_id", "seq", "message_key", "text").collect()
    assert sorted(map(tuple, log), key=str) == sorted(seen.values(), key=str)
    snapshot, cut = subscription.connect(spark, folder)
    assert snapshot_of(snapshot) == plain(seen.values()) and subscription.deltas(spark, folder, cut).count() == 0
    # a snapshot cut earlier and the messages after it are the whole log
    for at in range(cut):
        early, there = subscription.connect(spark, folder, at)
        first, rest = snapshot_of(early), [tuple(r) for r in subscription.deltas(spark, folder, there).collect()]
        assert there == at and sum(n for _, n, _ in first.values()) + len(rest) == len(seen)
        assert all(seq > first.get(run, (0,))[0] for run, seq, *_ in rest)


def test_other_content_under_a_known_key(spark, tmp_path):
    folder = f"file://{tmp_path}/sink"
    subscription.store(spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "a", "x")], SCHEMA), 0, folder)
    subscription.store(spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y")], SCHEMA), 1, folder)
    assert snapshot_of(subscription.connect(spark, folder)[0]) == {1: (2, 2, "xy")}
    for bad in ([(1, 3, "a", "other")], [(1, 4, "n", "p"), (1, 4, "n", "q")]):
        with pytest.raises(ValueError):
            subscription.store(spark.createDataFrame(bad, SCHEMA), 2, folder)
    assert subscription.connect(spark, folder)[1] == 1


def test_late_messages_and_tails(spark):
    df = lambda rows: spark.createDataFrame(rows, "run_id long, seq long, text string")
    state = subscription.folded(None, df([(1, 5, "abc"), (1, 3, "xyz"), (1, 5, "abc")]), 5)
    assert snapshot_of(state) == {1: (5, 2, "yzabc")}
    assert snapshot_of(subscription.folded(state, df([(1, 4, "late"), (1, 6, "d"), (2, 1, None)]), 5)) == {1: (6, 3, "zabcd"), 2: (1, 1, "")}
    assert subscription.folded(None, df([])).count() == 0


FACTS = "producer string, name string, kind string, value long"


def test_contributions(spark, tmp_path):
    path, dims = f"file://{tmp_path}/facts", {"entity": ["name", "kind"]}
    rows = [("p1", "Ann", "person", 1), ("p1", "Bob", "person", 2), ("p1", "Bob", "person", 2), ("p2", "Ann", "person", 3), ("p2", None, None, 4), ("p2", "Ann", "place", 5)]
    df = spark.createDataFrame(rows, FACTS)
    told = lambda d: sorted(map(tuple, contributions.contribute(d, path, dims).collect()))
    assert told(df) == [("p1", 3, True), ("p2", 3, True)]
    facts, entities = spark.read.parquet(f"{path}/facts"), lambda: spark.read.parquet(f"{path}/entity")
    assert facts.count() == 6 and entities().count() == 3 and entities().select("entity_id").distinct().count() == 3
    # the same again, in another order and with a new producer: only that one is appended, and a known entity keeps its id
    again = spark.createDataFrame([*rows[::-1], ("p3", "Ann", "person", 9), ("p3", "Cy", "person", 9)], FACTS)
    assert told(again.repartition(3)) == [("p1", 3, False), ("p2", 3, False), ("p3", 2, True)]
    assert spark.read.parquet(f"{path}/facts").count() == 8 and entities().count() == 4
    joined = spark.read.parquet(f"{path}/facts").join(entities(), "entity_id", "left").select("producer", "name", "kind", "value")
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    # a changed, a shortened and a repeated row are all differences
    for bad in (rows[:2] + [("p1", "Bob", "person", 7)], rows[:2], rows[:3] + rows[2:3]):
        with pytest.raises(ValueError):
            told(spark.createDataFrame([("p4", "New", "person", 1), *bad], FACTS))
    assert spark.read.parquet(f"{path}/facts").count() == 8 and entities().count() == 4  # nothing of p4
    assert told(df.limit(0)) == []


def test_stored_facts_are_checked(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    df = spark.createDataFrame([("p1", "a", "b", 1), ("p1", "c", "d", 2)], FACTS)
    contributions.contribute(df, path)
    df.limit(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("producer").parquet(f"{path}/facts")
    with pytest.raises(ValueError):
        contributions.contribute(df, path)


def test_unmarked_facts_are_written_over(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    df = spark.createDataFrame([("p1", "a", "b", 1), ("p1", "c", "d", 2)], FACTS)
    df.limit(1).write.partitionBy("producer").parquet(f"{path}/facts")  # what a failed write has left
    assert [tuple(r) for r in contributions.contribute(df, path).collect()] == [("p1", 2, True)]
    assert spark.read.parquet(f"{path}/facts").count() == 2


def test_fingerprint(spark):
    df = spark.createDataFrame([("p", "a", None, 1), ("p", None, "a", 1), ("q", "a", None, 1)], FACTS)
    marks = {r["producer"]: tuple(r)[1:] for r in contributions.fingerprint(df).collect()}
    swapped = {r["producer"]: tuple(r)[1:] for r in contributions.fingerprint(df.orderBy(F.desc("name"))).collect()}
    assert marks == swapped and marks["p"] != marks["q"]
