"""Token counts of whole texts by a two-tier lookup on the map side, without a shuffle of pre-tokens.

A pre-token is a stretch that no piece of the vocabulary crosses: the text, with its spaces as marks and one mark put
before it, is cut at line feeds and before each run of marks. The merges of one pre-token never touch another, so a text's
count is the sum of its pre-tokens' counts (checked when the model is loaded). First tier: a sorted table (hash, tokens) of the
frequent pre-tokens, of ``FREQUENT`` entries at most, broadcast. Second tier: each worker's cache of the pre-tokens that
the first one misses, each encoded once. The frequent ones are found in one pass over all texts, in which each task keeps a
bounded summary (Misra and Gries) and hands on its ``SUMMARY`` best. What that table holds changes the speed, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import table, text_blocks, without

TOKENIZER, LIMIT = "piece_bpe_32k.model", 4096
#: Entries of the broadcast table (12 bytes each), and what a task keeps at once and hands on at most.
FREQUENT, KEPT, SUMMARY = 1 << 16, 1 << 16, 1 << 12
#: Longest pre-token of the table and of a worker's cache, in bytes; longer ones are encoded where they stand.
LONGEST = 64
#: Pre-tokens that a worker remembers (10 bytes each); then it forgets all and starts anew.
CACHED = 2_000_000
COLUMNS = ("n_bytes", "n_tokens", "over_limit")
_MARK, _SPACE, _FEED = "▁", 32, 10


class PieceCounts:
    """Token counts of pre-tokens by one sentencepiece model."""

    def __init__(self, path: str | None):
        import sentencepiece

        if not path:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if _MARK in piece.lstrip(_MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses pre-tokens")
        probe = "a  b \n\nc d\n e "
        if self.whole([probe])[0] != sum(self.counts([s.encode() for s in (" a", "  b", " ", "c", " d", " e", " ")])) + 3:
            raise ValueError("the model's tokens are not those of its pre-tokens")

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def counts(self, found: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token, given as bytes with spaces for marks. The model puts a mark before each text it is given."""
        texts = [s.decode("utf-8") for s in found]
        # a pre-token after a line feed has no mark: it is encoded behind one, and the two tokens before it are taken off
        out = self.whole([t[1:] if t.startswith(" ") else "\n" + t for t in texts])
        return np.array([1 if t == " " else n if t.startswith(" ") else n - 2 for t, n in zip(texts, out)], np.int64)


def pretokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a block of texts, starts and ends of the pre-tokens in them, each text's first pre-token, and its number of line feeds."""
    col = pc.fill_null(col, "")
    col = pc.replace_substring(col, _MARK, " ")
    col = pc.if_else(pc.equal(pc.binary_length(col), 0), col, pc.binary_join_element_wise(pa.scalar("", col.type), col, pa.scalar(" ", col.type)))
    data, offs = K.buffers(col)
    if not len(data):
        z = np.zeros(0, np.int64)
        return data, z, z, np.zeros(len(offs), np.int64), np.zeros(len(offs) - 1, np.int64)
    feed, space = data == _FEED, data == _SPACE
    begin = np.zeros(len(data) + 1, bool)
    begin[offs] = True
    begin = begin[:-1]
    begin[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    begin &= ~feed
    cuts = np.flatnonzero(begin | feed)
    ends = np.append(cuts[1:], len(data))
    real = begin[cuts]
    starts, ends = cuts[real], ends[real]
    total = np.concatenate([[0], np.cumsum(feed)])
    return data, starts, ends, np.searchsorted(starts, offs), total[offs[1:]] - total[offs[:-1]]


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes ``h`` the sorted table has, and their values (0 for the others)."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    has = keys[at] == h
    return has, np.where(has, values[at], 0).astype(np.int64)


class Worker:
    """The second tier: counts of pre-tokens that the broadcast table misses."""

    def __init__(self, path: str | None):
        self.pieces = PieceCounts(path)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.uint16)

    def count(self, col: pa.Array, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Tokens of every text of a block."""
        data, starts, ends, first, feeds = pretokens(col)
        h = K.span_hashes(data, starts, ends, None) if len(starts) else np.zeros(0, np.uint64)
        has, n = _look(*frequent, h)
        miss = np.flatnonzero(~has)
        if len(miss):
            if len(self.keys) > CACHED:
                self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
            had, told = _look(self.keys, self.values, h[miss])
            n[miss] = told
            miss = miss[~had]
            raw = data.tobytes()
            new, which, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[which]
            got = self.pieces.counts([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]) if len(at) else np.zeros(0, np.int64)
            n[miss] = got[back]
            keep = ends[at] - starts[at] <= LONGEST
            spot = np.searchsorted(self.keys, new[keep])
            self.keys, self.values = np.insert(self.keys, spot, new[keep]), np.insert(self.values, spot, got[keep])
        total = np.concatenate([[0], np.cumsum(n)])
        return total[first[1:]] - total[first[:-1]] + feeds


_known: dict[str | None, Worker] = {}


def worker(path: str | None) -> Worker:
    if path not in _known:
        _known[path] = Worker(path)
    return _known[path]


def summary(docs: DataFrame) -> DataFrame:
    """(hash, pre-token, n) of the most frequent pre-tokens of each task of ``docs(text)``: ``SUMMARY`` rows a task at most.

    A task keeps 2 * ``KEPT`` counters at most: when there are more, the ``KEPT``-th largest count is taken from all and
    the counters that reach zero go, so a pre-token of more than one in ``KEPT`` of the task's is never lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            for block in text_blocks(batch):
                data, starts, ends, _, _ = pretokens(block.column(0))
                short = ends - starts <= LONGEST
                starts, ends = starts[short], ends[short]
                if not len(starts):
                    continue
                new, which, n = np.unique(K.span_hashes(data, starts, ends, None), return_index=True, return_counts=True)
                has, _ = _look(keys, counts, new)
                counts[np.searchsorted(keys, new[has])] += n[has]
                raw, which = data.tobytes(), which[~has]
                spot = np.searchsorted(keys, new[~has])
                text = np.array([raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())], object)
                keys, counts, names = np.insert(keys, spot, new[~has]), np.insert(counts, spot, n[~has]), np.insert(names, spot, text)
                if len(keys) > 2 * KEPT:
                    counts -= np.partition(counts, len(counts) - KEPT)[len(counts) - KEPT]
                    some = counts > 0
                    keys, counts, names = keys[some], counts[some], names[some]
        best = np.argsort(-counts, kind="stable")[:SUMMARY]
        yield pa.RecordBatch.from_arrays([pa.array(keys[best].view(np.int64)), pa.array(list(names[best]), pa.binary()), pa.array(counts[best])], ["h", "pre", "n"])

    return docs.select("text").mapInArrow(run, "h long, pre binary, n long")


def frequent_table(docs: DataFrame, tokenizer: str | None = None, entries: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the ``entries`` most frequent pre-tokens by the tasks' summaries, and their tokens."""
    rows = summary(docs).groupBy("h").agg(F.min("pre").alias("pre"), F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(entries).toArrow()
    keys = rows.column("h").to_numpy().view(np.uint64)
    counts = PieceCounts(tokenizer).counts(rows.column("pre").to_pylist()) if len(keys) else np.zeros(0, np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.uint16)


def count_tokens(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs(text, ...)`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    A null or empty text has 0 bytes and 0 tokens. Strings that look like special tokens are ordinary text, as the library
    takes them; nothing is truncated, padded or added. Repeated rows are counted each; an empty table gives an empty result;
    columns of the result's names are replaced, all others stay. ``tokenizer`` is the path of a sentencepiece model no piece
    of which crosses a pre-token (else ValueError); ``frequent`` a table of ``frequent_table``, found from ``docs`` where none is given.
    """
    docs = without(docs, *COLUMNS)
    shared = docs.sparkSession.sparkContext.broadcast(frequent if frequent is not None else frequent_table(docs, tokenizer))
    names = docs.columns
    at = next(i for i, n in enumerate(names) if n.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = worker(tokenizer)
        for batch in batches:
            for block in text_blocks(batch, names[at]):
                col = block.column(at)
                size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
                n = w.count(col, shared.value)
                yield pa.RecordBatch.from_arrays([*block.columns, size, pa.array(n), pa.array(n > limit)], [*names, *COLUMNS])

    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{plain}n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COLUMNS)
