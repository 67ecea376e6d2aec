"""Repair of a conversation's structure by shortest paths over its turns.

A repaired conversation has the roles ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in turn. The rows of a
conversation and the four states of that pattern make a graph whose arcs are edits (keep, rerole, delete, insert) of small
integer cost. Distances to the end are found by Dial's algorithm (a ring of as many buckets as the costs allow, from the
end towards the start); then the tight arcs are walked from the start, the least letter first, which gives the cheapest
edits that are least as a string.

Spark deals the conversations out by id and sorts each: first the codes of its rows (a byte each), from which the edits are
found, then the rows with their texts, which stream through the hash one by one. So a task holds some 40 bytes a row of one
conversation, whose edits are one string anyway, and never its texts. Repeated turns are told before, by a window over
(conversation, role and text), in which no text travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyspark.llm.common import table, text_blocks

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: [\x20\x09-\x0D]
_BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The turn's role that leads on, and to where.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FREE = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_ENDS = (0, 3)
_ROLE = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}


def distances(roles: Sequence[str], faults: bytes) -> np.ndarray:
    """Least cost from every (row, state) to the end, by Dial's bucket queue from the end; nodes farther than the start have -1.

    ``roles`` has one letter a row (the role's initial; any other than s, u, a fits nowhere), ``faults`` 0 (none), 1 (blank),
    2 (duplicate) or 3 (truncated) a row.
    """
    n, most = len(roles), max(KEEP + TRUNCATED, REROLE + TRUNCATED, DELETE, INSERT)
    dist = np.full((n + 1, 4), -1, np.int32)
    ring: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
    ring[0] = [(n, s) for s in _ENDS]
    d, waiting = 0, 2
    while waiting:
        bucket = ring[d % (most + 1)]
        while bucket:
            i, s = bucket.pop()
            waiting -= 1
            if dist[i, s] >= 0:
                continue
            dist[i, s] = d
            before = [(i, p, INSERT) for p in range(4) if _FREE[p][1] == s]
            if i:
                before.append((i - 1, s, DELETE))
                if faults[i - 1] in (0, 3):
                    more, c = (TRUNCATED if faults[i - 1] else 0), roles[i - 1]
                    before += [(i - 1, p, KEEP + more) for p in range(4) if _NEXT[p].get(c) == s]
                    before += [(i - 1, p, REROLE + more) for p in range(4) if _FREE[p][1] == s]
            for j, p, c in before:
                if dist[j, p] < 0:
                    ring[(d + c) % (most + 1)].append((j, p))
                    waiting += 1
        if dist[0, 0] >= 0:  # with all nodes as far as the start, to which arcs without cost may lead
            break
        d += 1
    return dist


def cheapest(roles: Sequence[str], faults: bytes) -> tuple[int, str]:
    """Cost of the cheapest edits, and their letters D, I, K, R in order, least as ASCII among the cheapest."""
    dist, n = distances(roles, faults), len(roles)
    i = s = 0
    out = []
    while i < n or s not in _ENDS or dist[i, s]:
        here = dist[i, s]
        tight = lambda j, t, c: dist[j, t] >= 0 and dist[j, t] + c == here
        free, stays = _FREE[s][1], i < n and faults[i] in (0, 3)
        more = TRUNCATED if stays and faults[i] else 0
        if i < n and tight(i + 1, s, DELETE):
            out.append("D")
            i += 1
        elif tight(i, free, INSERT):
            out.append("I")
            s = free
        elif stays and roles[i] in _NEXT[s] and tight(i + 1, _NEXT[s][roles[i]], KEEP + more):
            out.append("K")
            i, s = i + 1, _NEXT[s][roles[i]]
        else:
            out.append("R")
            i, s = i + 1, free
    return int(dist[0, 0]), "".join(out)


class _Repair:
    """One conversation as its rows come by: codes first, then texts."""

    def __init__(self, conv):
        self.conv, self.letters, self.faults = conv, [], bytearray()
        self.low = self.high = self.last = None
        self.distinct, self.audit, self.at, self.state, self.hash, self.any = 0, None, 0, 0, hashlib.sha256(), False

    def code(self, turn: int | None, letter: str, fault: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last
            self.high = self.last = turn
        self.letters.append(letter)
        self.faults.append(fault)

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(self.letters, bytes(self.faults))

    def _put(self, line: str) -> None:
        self.hash.update((("\n" if self.any else "") + line).encode("utf-8"))
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = _FREE[self.state]
            self._put(_ROLE[role] + ":")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self.solve()
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state][role[:1]]
            self._put(f"{role}:{text}")
        elif edit == "R":
            to, self.state = _FREE[self.state]
            self._put(f"{_ROLE[to]}:{text}")

    def row(self) -> tuple:
        self.solve()
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        illegal = sum(a + b not in _LEGAL for a, b in zip(self.letters, self.letters[1:]))
        return (self.conv, gaps, *(self.faults.count(k) for k in (1, 2, 3)), illegal, self.cost, self.audit, self.hash.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as the query damages them: crc32 of ``conv_id:turn`` modulo 20 tells how. Nulls are read as one space.

    A dropped row stays with ``copies`` 0, a repeated one has 2.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text[, copies])``: faults, cheapest edits and the hash of what they give.

    A row counts as often as its ``copies`` say (without that column, once); a conversation without rows has zeros and an empty audit. Rows
    stand by turn, nulls first, rows of one turn by the role's initial and then by a hash of role and text; equal rows are adjacent. A null role or text is one
    space; a null conv_id is a conversation of its own; a role that begins with none of s, u, a (an empty one too) fits no place and must be
    reroled or deleted. Of a conversation's edits of equal cost the ASCII-least stand. An empty table gives an empty result; other columns are not read.
    """
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    names = {c.lower() for c in rows.columns}
    copies = F.col("copies") if "copies" in names else F.lit(1)
    space = F.lit(" ")
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copies.cast("int").alias("copies"))
    key = F.xxhash64("role", "text")
    shown = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(shown == "", 1).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    each = F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))
    codes = base.select("conv_id", "turn", key.alias("key"), F.substring("role", 1, 1).alias("letter"), fault.alias("fault"), "copies", each.alias("copy"))
    earlier = Window.partitionBy("conv_id", "key", F.col("copies") > 0).orderBy(F.col("turn").asc_nulls_first(), "copy")
    codes = codes.withColumn("nth", F.row_number().over(earlier))
    # codes of a conversation sort before its texts; a dropped row only names its conversation
    codes = codes.select("conv_id", F.lit(0).alias("kind"), "turn", F.col("letter").alias("role"), "key", F.lit(None).cast("string").alias("text"), F.when(F.col("fault") == 1, 1).when(F.col("nth") > 1, 2).otherwise(F.col("fault")).alias("fault"), (F.col("copies") > 0).alias("there"))
    texts = base.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", key.alias("key"), "text", F.lit(0).alias("fault"), F.lit(True).alias("there"), each.alias("copy")).drop("copy")
    both = codes.unionByName(texts)
    # equal rows differ in the fault of the first one only, so the one without a repeat comes first
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), F.substring("role", 1, 1), "key", F.expr("fault = 2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [[]] * 9
            kinds = [out_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", *(x.split()[0] for x in RESULT.split(", "))])
            done.clear()
            return batch

        out_type = None
        for batch in batches:
            out_type = batch.schema.field(0).type
            for block in text_blocks(batch):
                for conv, kind, turn, role, text, fault, there in zip(*(c.to_pylist() for c in block.columns)):
                    if now is None or now.conv != conv:
                        if now is not None:
                            done.append(now.row())
                        now = _Repair(conv)
                    if kind:
                        now.text(role, text)
                    elif there:
                        now.code(turn, role, fault)
            if done:
                yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()

    return both.select("conv_id", "kind", "turn", "role", "text", "fault", "there").mapInArrow(run, f"conv_id {conv_type}, {RESULT}")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))
