"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with document shingles.

Every benchmark item is cut into windows of ``window`` words. A window that a document contains must have all its
word shingles in the document (containment 1), so by the prefix-filter principle one shingle is a necessary prefix:
the rarest one, by counts over all documents. Documents are probed with these prefix shingles only; the shingle's
place in the window and the document's length bound the possible place of the window, and each remaining candidate is
verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import materialize, table, text_blocks, without

#: Longest shingle, in words; windows of fewer words use shingles of their own length.
SHINGLE = 3
#: Bytes of benchmark text that one broadcast block may hold; a larger benchmark is joined block by block.
BLOCK_TEXT = 4 << 20
COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = K.buffers(col)
    s, e, first = K.runs(data, offs, K.ALNUM)
    return K.span_hashes(data, s, e), first


def _doc_shingles(words: np.ndarray, first: np.ndarray, k: int):
    """Shingle hashes with the number of their first word and of their text."""
    h, f = K.shingles(words, first, k)
    counts = np.diff(f)
    doc = np.repeat(np.arange(len(counts)), counts)
    return h, np.arange(len(h)) - f[doc] + first[doc], doc


class _Filter:
    """Membership in a sorted array, behind a bit table of one probe per key."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of known keys and the keys' numbers."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        no = np.searchsorted(self.keys, h[at])
        no[no == len(self.keys)] = 0
        ok = self.keys[no] == h[at]
        return at[ok], no[ok]


def _windows(rows: list, window: int) -> dict:
    """Distinct windows of a benchmark block: word matrix by length, and per window its items."""
    words, first = _words(pa.array([r["text"] for r in rows], pa.large_string()))
    wins: dict[bytes, int] = {}
    owner: list[set[str]] = []
    content: list[np.ndarray] = []
    for i, r in enumerate(rows):
        w = words[first[i] : first[i + 1]]
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            key = w[j : j + n].tobytes()
            no = wins.setdefault(key, len(wins))
            if no == len(owner):
                owner.append(set())
                content.append(w[j : j + n])
            if r["item_id"] is not None:
                owner[no].add(str(r["item_id"]))
    return {"content": content, "owner": [tuple(sorted(o)) for o in owner]}


def _window_shingles(content: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for w in content:
        k = min(SHINGLE, len(w))
        out.append(K.shingles(w, np.array([0, len(w)]), k)[0])
    return out


def _count(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, int]:
    """Occurrences in all documents of the benchmark's own shingles."""
    filters = docs.sparkSession.sparkContext.broadcast({k: _Filter(v) for k, v in keys.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(f.keys), np.int64) for k, f in filters.value.items()}
        for batch in batches:
            for block in text_blocks(batch):
                words, first = _words(block.column(0))
                for k, f in filters.value.items():
                    _, no = f.find(K.shingles(words, first, k)[0])
                    total[k] += np.bincount(no, minlength=len(f.keys))
        for k, f in filters.value.items():
            some = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(f.keys[some].view(np.int64)), pa.array(total[k][some])], ["key", "n"])

    rows = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    filters.destroy()
    return dict(zip(rows.column("key").to_numpy().view(np.uint64).tolist(), rows.column("n").to_pylist()))


def _index(block: dict, freq: dict[int, int]) -> dict[int, dict]:
    """For each shingle length: prefix shingles and, per shingle, the windows it stands for with its place in them."""
    by_k: dict[int, list[tuple[int, int, int]]] = {}
    for no, (w, sh) in enumerate(zip(block["content"], _window_shingles(block["content"]))):
        place = min(range(len(sh)), key=lambda j: (freq.get(int(sh[j]), 0), int(sh[j]), j))
        by_k.setdefault(min(SHINGLE, len(w)), []).append((int(sh[place]), no, place))
    out = {}
    for k, entries in by_k.items():
        entries.sort()
        keys = np.array([x[0] for x in entries], np.uint64)
        f = _Filter(keys)
        out[k] = {"filter": f, "at": np.searchsorted(keys, np.append(f.keys, f.keys[-1:]), "left"), "window": np.array([x[1] for x in entries]), "place": np.array([x[2] for x in entries])}
        out[k]["at"][-1] = len(entries)
    return out


def _probe(words: np.ndarray, first: np.ndarray, block: dict, hit: np.ndarray, items: list[set]) -> None:
    length, offset, flat = block["length"], block["offset"], block["flat"]
    for k, ix in block["index"].items():
        h, start_word, doc = _doc_shingles(words, first, k)
        at, no = ix["filter"].find(h)
        if not len(at):
            continue
        n = ix["at"][no + 1] - ix["at"][no]
        at, entry = np.repeat(at, n), np.repeat(ix["at"][no], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        win, d = ix["window"][entry], doc[at]
        begin = start_word[at] - ix["place"][entry]
        ok = (begin >= first[d]) & (begin + length[win] <= first[d + 1])
        win, d, begin = win[ok], d[ok], begin[ok]
        for j in range(int(length[win].max()) if len(win) else 0):
            same = (j >= length[win]) | (words[np.minimum(begin + j, len(words) - 1)] == flat[np.minimum(offset[win] + j, len(flat) - 1)])
            win, d, begin = win[same], d[same], begin[same]
        for j in range(int(length[win].max()) if len(win) else 0):
            inside = j < length[win]
            hit[begin[inside] + j] = True
        for x, w in {*zip(d.tolist(), win.tolist())}:
            items[x].update(block["owner"][w])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit if it lies in an occurrence of a window of ``window`` consecutive words of a benchmark item (an item of
    fewer words is one window). Null or empty texts have no words and are clean; null or wordless items match nothing; an
    item whose id is null hits words but is not counted. Repeated rows are judged each. Existing columns of the result's
    names are replaced. A benchmark of more than ``BLOCK_TEXT`` bytes is joined block by block, with the same result.
    An empty table gives an empty one, an empty benchmark leaves all clean; other columns pass through. Whole texts of any length are read.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // BLOCK_TEXT))
    docs = without(docs, *COLUMNS)
    state = "_storyspark_hits array<int>, _storyspark_items array<string>"
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        block = _windows(mine.collect(), window)
        shingles = _window_shingles(block["content"])
        keys: dict[int, list[np.ndarray]] = {}
        for w, sh in zip(block["content"], shingles):
            keys.setdefault(min(SHINGLE, len(w)), []).append(sh)
        freq = _count(docs, {k: np.concatenate(v) for k, v in keys.items()}) if keys else {}
        block["index"] = _index(block, freq)
        block["length"] = np.array([len(w) for w in block["content"]], np.int64)
        block["offset"] = np.cumsum(block["length"]) - block["length"]
        block["flat"] = np.concatenate(block.pop("content")) if len(block["length"]) else np.zeros(1, np.uint64)
        last = part == parts - 1
        shared = spark.sparkContext.broadcast(block)
        held = part > 0
        base = [f.name for f in docs.schema if f.name not in ("_storyspark_hits", "_storyspark_items")]
        text_at = base.index("text")

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, held=held, last=last, base=base, text_at=text_at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part_batch in text_blocks(batch):
                    words, first = _words(part_batch.column(text_at))
                    hit, found = np.zeros(len(words), bool), [set() for _ in range(part_batch.num_rows)]
                    if held:
                        for i, x in enumerate(part_batch.column(len(base)).to_pylist()):
                            hit[np.array(x, np.int64) + first[i]] = True
                        for i, x in enumerate(part_batch.column(len(base) + 1).to_pylist()):
                            found[i].update(x)
                    _probe(words, first, shared.value, hit, found)
                    cols = [part_batch.column(i) for i in range(len(base))]
                    if not last:
                        more = [pa.array([np.flatnonzero(hit[first[i] : first[i + 1]]).astype(np.int32) for i in range(len(found))], pa.list_(pa.int32())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(cols + more, [*base, "_storyspark_hits", "_storyspark_items"])
                        continue
                    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
                    more = [
                        pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found], pa.string()), pa.array(n_hit > 0),
                    ]
                    yield pa.RecordBatch.from_arrays(cols + more, [*base, *COLUMNS])

        plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in base)
        docs = docs.mapInArrow(probe, f"{plain}, " + (state if not last else "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"))
        if not last:
            docs = materialize(docs)
    return docs


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", *COLUMNS)
