"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best fit. Pieces and gaps are ordered by length; since a length is one of ``capacity`` values, the order
is kept as runs: per length the number of pieces, per gap size the sequences that share it. A superstep takes the
longest unplaced run, sweeps to its successor (the smallest gap that holds it), and moves as many pieces as the run and
the gaps allow; a piece's rank within its length decides which gap it gets, so no two pieces claim one place. Gaps shrink,
and the steps repeat until every run is placed; runs without a successor open new sequences. The runs (at most
``capacity`` of them, whatever the size of the corpus) are swept on the driver; tokenising, ranking and the placement of
each piece by its rank are distributed. The result is that of best-fit-decreasing over single pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import materialize, table, text_blocks

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
#: Distinct words whose ids a worker remembers (about 30 bytes each); then it forgets all and starts anew.
MEMORY_WORDS = 3_000_000
_SEPARATOR, _SEPARATOR_ID = "<|endoftext|>", 49407
_ALNUM = K.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_MARK = K.byte_class((0x2C, 0x2C), (0x2E, 0x2E))


class WordIds:
    """Token ids of white-space-separated words, each distinct word tokenised once per worker.

    The tokenizer drops white space before it merges, so a text's ids are its words' ids in order; a final ``.`` or ``,``
    after an ASCII letter or digit is a token run of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        plain = [w for w in words if "<" not in w]
        stream = np.array(self.tokenizer.encode(_SEPARATOR.join(plain), add_special_tokens=False).ids, np.uint16)
        cuts = np.flatnonzero(stream == _SEPARATOR_ID)
        begin, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(stream)]])
        n, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        is_plain = np.array(["<" not in w for w in words], bool)
        if plain:
            at[is_plain], n[is_plain] = begin, end - begin
        more = [stream]
        used = len(stream)
        for i in np.flatnonzero(~is_plain):
            ids = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint16)
            at[i], n[i] = used, len(ids)
            used += len(ids)
            more.append(ids)
        at += len(self.flat)
        self.flat = np.concatenate([self.flat, *more])
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, spot, keys), np.insert(self.at, spot, at), np.insert(self.n, spot, n)

    def encode(self, col: pa.Array, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, as one uint32 array, and the texts' borders in it."""
        data, offs = K.buffers(col)
        starts, ends, _ = K.runs(data, offs, K.NONSPACE)
        split = (ends - starts > 1) & _MARK[data[ends - 1]] & _ALNUM[data[np.maximum(ends - 2, 0)]] if len(starts) else np.zeros(0, bool)
        mark = ends[split] - 1
        starts, ends = np.sort(np.concatenate([starts, mark])), np.sort(np.concatenate([ends, mark]))
        first = np.searchsorted(starts, offs)
        raw = data.tobytes()
        h = K.span_hashes(data, starts, ends, None if b"<|" in raw else K.LOWER)
        if len(self.keys) > MEMORY_WORDS:
            self.clear()
        for _ in range(2):
            spot = np.searchsorted(self.keys, h)
            if len(self.keys):
                spot[spot == len(self.keys)] = 0
                new = np.flatnonzero(self.keys[spot] != h)
            else:
                new = np.arange(len(h))
            if not len(new):
                break
            keys, which = np.unique(h[new], return_index=True)
            self._learn(keys, [raw[starts[i] : ends[i]].decode("utf-8") for i in new[which]])
        n = self.n[spot] if len(h) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((self.at[spot] if len(h) else n) - total[:-1], n) + np.arange(total[-1])
        borders = total[first] + np.arange(len(offs))
        out = np.full(borders[-1], end_id, np.uint32)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(total[first]))
        out[np.arange(total[-1]) + doc] = self.flat[place]
        return out, borders


_known: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``, with the task that made each and its rank among that task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_ids(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for block in text_blocks(batch):
                ids, borders = coder.encode(block.column(1))
                size = np.diff(borders)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(sorted_length, sorted_length) + seen[sorted_length]
                seen += np.bincount(length, minlength=capacity + 1)
                view = memoryview(ids.astype("<u4")).cast("B")
                at = (borders[doc] + start) * 4
                crc = [zlib.crc32(view[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
                cols = [block.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    cols.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip((at // 4).tolist(), length.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, by length and rank: (length, first rank, end rank, first sequence, pieces of it per sequence, offset).

    A run of ``n`` pieces meets gap classes (size -> list of [first sequence, sequences]); all sequences of one list entry
    are filled alike.
    """
    gaps: dict[int, list[list[int]]] = {}
    sizes: list[int] = []
    out, opened = [], 0

    def give(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append([first, n])

    for length in sorted(counts, reverse=True):
        n, rank = counts[length], 0
        while n:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                size = sizes[i]
                first, have = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(i)
            else:
                size, first = capacity, opened
                have = -(-n // (capacity // length))
                opened += have
            each = size // length
            whole = min(have, n // each)
            if whole:
                out.append((length, rank, rank + whole * each, first, each, capacity - size))
                rank, n = rank + whole * each, n - whole * each
                give(size - each * length, first, whole)
                first, have = first + whole, have - whole
            if have and 0 < n < each:
                out.append((length, rank, rank + n, first, n, capacity - size))
                give(size - n * length, first, 1)
                first, have, rank, n = first + 1, have - 1, rank + n, 0
            give(size, first, have)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids are its text's ids and then id 0 (null text: empty, so one id). Only documents longer than ``capacity``
    are cut. Every row is packed, repeated and null ids too. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, capacity, tokenizer, with_ids))
    runs = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    placed = plan(counts, capacity)
    steps = spark.createDataFrame(placed or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, base long, each long, offset0 long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = runs.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = made.join(begins, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("begin"))
    # at most a few runs a length, and lengths are bounded by capacity: the plan's size does not grow with the corpus
    out = ranked.join(F.broadcast(steps), "length").where("rank >= lo and rank < hi")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("offset0") + (F.col("rank") - F.col("lo")) % F.col("each") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
