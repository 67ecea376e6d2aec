"""The notification log as a stream: idempotent append, replay and a stateful projection per run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Bounds of the projection's state.
TAIL, IDLE_MS = 8192, 3_600_000
OUT = "run_id long, last_seq long, messages long, tail string"


def idempotent(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Messages without repeats of a run's message key within the watermark (batch: without any)."""
    if messages.isStreaming:
        return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "message_key"])
    return messages.dropDuplicates(["run_id", "message_key"])


def fold(state: tuple[int, int, str], batches: Iterable[pd.DataFrame]) -> tuple[int, int, str]:
    """A run's state after more messages, in frames of any order: those at or before the cursor are ignored, a repeated seq counts once.

    Of all the messages only their numbers are kept (8 bytes each), and the texts of the newest ones that reach into the tail.
    """
    cursor, count, tail = state
    seqs, newest = np.zeros(0, np.int64), pd.DataFrame({"seq": np.zeros(0, np.int64), "text": np.zeros(0, object)})
    for rows in batches:
        rows = rows.loc[rows["seq"] > cursor, ["seq", "text"]]
        if rows.empty:
            continue
        seqs = np.union1d(seqs, rows["seq"].to_numpy(np.int64))
        rows = rows.assign(text=rows["text"].fillna("").astype(object))
        newest = (pd.concat([newest, rows]) if len(newest) else rows).sort_values("seq", ascending=False, kind="stable").drop_duplicates("seq")
        after = newest["text"].str.len().cumsum() - newest["text"].str.len()
        newest = newest[after < TAIL]
    if not len(seqs):
        return state
    return int(seqs[-1]), count + len(seqs), (tail + "".join(newest["text"][::-1]))[-TAIL:]


def project(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of (run_id, last_seq, messages, tail) from (run_id, seq, text, ts), one row per run and trigger.

    A run's state expires when the watermark has passed its last message by ``IDLE_MS``. The clock is that of the messages, not the
    machine's: with a processing-time timeout each batch would ask for another, and a run to the end of a source never ended.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = 0

        def timed_rows() -> Iterator[pd.DataFrame]:
            nonlocal last
            for pdf in batches:
                last = max(last, int(pdf["ms"].max()))
                yield pdf

        # a run's messages of one trigger may come in several frames, in no order
        now = fold(tuple(state.get) if state.exists else (-1, 0, ""), timed_rows())
        state.update(now)
        state.setTimeoutTimestamp(max(last + IDLE_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *now)], columns=["run_id", "last_seq", "messages", "tail"])

    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return timed.groupBy("run_id").applyInPandasWithState(run, OUT, "last_seq long, messages long, tail string", "update", GroupStateTimeout.EventTimeTimeout)


def tails(messages: DataFrame, size: int = TAIL) -> DataFrame:
    """(run_id, last_seq, messages, tail) of ``messages(run_id, seq, text)``: the last ``size`` characters of the texts in order.

    Only the messages that reach into the tail are gathered: at most ``size`` of a run that have any text.
    """
    whole = messages.groupBy("run_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("messages"))
    newest = Window.partitionBy("run_id").orderBy(F.desc("seq"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.char_length(F.coalesce("text", F.lit("")))
    reach = messages.where(F.coalesce("text", F.lit("")) != "").withColumn("after", F.coalesce(F.sum(n).over(newest), F.lit(0))).where(F.col("after") < size)
    parts = reach.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    tail = parts.select("run_id", F.when(F.char_length(text) > size, F.right(text, F.lit(size))).otherwise(text).alias("tail"))
    return whole.join(tail, "run_id", "left").select("run_id", "last_seq", "messages", F.coalesce("tail", F.lit("")).alias("tail"))


def folded(state: DataFrame | None, messages: DataFrame, size: int = TAIL) -> DataFrame:
    """The projection of each run after more ``messages(run_id, seq, text)``: those at or before its cursor are ignored, a repeated seq counts once."""
    messages = messages.groupBy("run_id", "seq").agg(F.min("text").alias("text"))
    if state is None:
        return tails(messages, size)
    cursor = state.select("run_id", F.col("last_seq").alias("cursor"), F.col("messages").alias("had"), F.col("tail").alias("before"))
    later = messages.join(cursor.select("run_id", "cursor"), "run_id", "left").where(F.col("cursor").isNull() | (F.col("seq") > F.col("cursor"))).drop("cursor")
    new = tails(later, size)
    text = F.concat(F.coalesce("before", F.lit("")), "tail")
    return new.join(cursor, "run_id", "left").select("run_id", "last_seq", (F.col("messages") + F.coalesce("had", F.lit(0))).alias("messages"), F.when(F.char_length(text) > size, F.right(text, F.lit(size))).otherwise(text).alias("tail"))


def project_batch(messages: DataFrame) -> DataFrame:
    """The same projection over a whole log."""
    return folded(None, messages)


def replay(messages: DataFrame, cursor: int, page: int = 128) -> DataFrame:
    """The next page of a log after a cursor."""
    return messages.where(F.col("seq") > cursor).orderBy("seq").limit(page)


def trailing_health(turns: DataFrame, length: str = "30 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Turns and failures of each model in trailing windows."""
    return turns.withWatermark("ts", delay).groupBy("model", F.window("ts", length, slide)).agg(F.count("*").alias("turns"), F.count_if("failed").alias("failures"))


def idle_sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions that end after an idle gap."""
    return events.groupBy("run_id", F.session_window("ts", gap)).agg(F.count("*").alias("messages"))
