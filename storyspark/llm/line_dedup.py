"""Line dedup by pairwise alignment.

A line is a stretch of text up to a line feed, to the space after ``.``, ``!`` or ``?``, or, in a sentence of more than ``LONG``
words, to the space after a word that with its next word has the least hash of some ``CUT`` successive pairs (so that a passage
copied into the middle of a sentence holds whole lines too: 49 successive words hold two such cuts at least 8 words apart
wherever they stand). A block is the shortest run of lines from a line on that has
``MIN_BLOCK`` words. Blocks are hashed; a hash that several documents hold makes each of them overlap with
the first (smallest doc_id) that holds it, so a block that n documents share makes n - 1 pairs, and every run of lines that a
document shares with an earlier one consists of blocks that it shares whole with their first holders. Each pair is aligned by
patience diff over its shared blocks: blocks that occur once on both sides are anchors, the longest increasing chain of
anchors is kept, the ranges between are aligned alike, and anchors extend to equal neighbours; in a range without such blocks
the n-th occurrences of a block are anchors of each other. What is left over is aligned again, so that moved blocks are found
too, and what the later document holds more often than the earlier one is aligned with blocks already used.
The lines of aligned blocks are deleted from the later document.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import discard, is_known, known_keys, materialize, table, text_blocks, without

MIN_BLOCK = 8
#: Within a piece of a sentence of more than LONG words the first cut that does not depend on what stands around the piece comes
#: after 2 * CUT words at most from its border. A passage of n words thus holds two cuts n - 4 * CUT words apart or, where one
#: end lies in a short sentence, n - LONG - 2 * CUT.
CUT, LONG = 10, 20
COLUMNS = ("n_lines", "n_removed")


def least(hashes: np.ndarray, first: np.ndarray, width: int = CUT) -> np.ndarray:
    """Which items have the least hash of some ``width`` successive ones of a group (items of the same hash alike); ``first``: each group's first."""
    n = len(hashes) - width + 1
    out = np.zeros(len(hashes), bool)
    if n <= 0:
        return out
    low, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    whole = np.zeros(n, bool)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.equal(text[:n], text[width - 1 :], out=whole)
    for step in range(width):
        out[step : step + n] |= whole & (hashes[step : step + n] == low)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of two sorted arrays, sorted (a stable sort merges them)."""
    x = np.sort(np.concatenate([a, b]), kind="stable")
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first line of each text, hashes, words) of the lines of a block of texts."""
    data, offs = K.buffers(col)
    cut = (data == 10) | (data == 13)
    if len(data) > 1:
        before = data[:-1]
        cut[1:] |= (data[1:] == 32) & ((before == 0x2E) | (before == 0x21) | (before == 0x3F))
    words, word_ends, per_text = K.runs(data, offs, K.NONSPACE)
    total = K.running_hash(data, None)
    if len(words):
        # the words of long sentences, and where their sentences begin
        number = np.searchsorted(np.flatnonzero(cut), words, "right")
        opens = np.append(True, number[1:] != number[:-1])
        opens[per_text[per_text < len(words)]] = True
        begin = np.flatnonzero(opens)
        count = np.diff(np.append(begin, len(words)))
        at = np.flatnonzero(np.repeat(count > LONG, count))
        count = count[count > LONG]
        first = np.concatenate([[0], np.cumsum(count)])
        h = K.spans_of(total, words[at], word_ends[at])
        h[:-1] = K.mix(h[:-1]) + h[1:]
        pair = np.ones(len(h), bool)
        pair[first[1:] - 1] = False
        cut[word_ends[at[pair][least(h[pair], first - np.arange(len(first)))]]] = True
    # the runs of bytes that are no cut, by the cuts alone: they are few
    at = np.flatnonzero(cut)
    starts = merged(offs[:-1], at + 1)
    starts = starts[starts < offs[-1]]
    starts = starts[~cut[starts]]
    ends = merged(offs[1:], at)
    ends = ends[ends > offs[0]]
    ends = ends[~cut[ends - 1]]
    n = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    first = np.searchsorted(starts, offs)
    opens = np.zeros(len(starts), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    head = np.flatnonzero(opens | (n > 0))
    if len(head):
        last = np.append(head[1:], len(starts)) - 1
        starts, ends, n = starts[head], ends[last], np.add.reduceat(n, head)
    return data, starts, ends, np.searchsorted(starts, offs), K.spans_of(total, starts, ends), n


def blocks(first: np.ndarray, hashes: np.ndarray, words: np.ndarray, min_block: int = MIN_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, lines, words) of the shortest run of lines of ``min_block`` words from each line on; 0 lines where the text ends before."""
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(hashes))
    end = np.searchsorted(total, total[:-1] + max(min_block, 1))
    size = np.where(end <= np.repeat(first[1:], np.diff(first)), end - at, 0)
    out, going, step = np.zeros(len(hashes), np.uint64), np.flatnonzero(size), 0
    while len(going):
        out[going] = K.mix(out[going] + np.uint64(step)) + hashes[going + step]
        step += 1
        going = going[size[going] > step]
    return K.mix(out), size, total[at + size] - total[:-1]


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain increasing on both sides of pairs sorted by the first (patience sorting)."""
    tops: list[int] = []
    piles: list[tuple[int, int]] = []
    back: list[int] = []
    at: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    i = at[-1] if at else -1
    while i >= 0:
        piles.append(pairs[i])
        i = back[i]
    return piles[::-1]


def _numbered(rows: list[tuple[int, int]]) -> list[tuple[int, tuple[int, int]]]:
    """(place, (hash, occurrences before)) of each row."""
    seen: Counter = Counter()
    out = []
    for p, h in rows:
        out.append((p, (h, seen[h])))
        seen[h] += 1
    return out


def _patience(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matched places of two lists of (place, hash), each sorted by place."""
    found: dict[int, int] = {}
    taken: set[int] = set()
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        cx, cy = Counter(h for _, h in x), Counter(h for _, h in y)
        where = {h: p for p, h in y if cy[h] == 1}
        anchors = _chain([(p, where[h]) for p, h in x if cx[h] == 1 and h in where])
        if not anchors:
            where = {h: p for p, h in _numbered(y)}
            anchors = _chain([(p, where[h]) for p, h in _numbered(x) if h in where])
        if not anchors:
            continue
        hx, hy = dict(x), dict(y)
        for p, q in anchors:
            found[p] = q
            taken.add(q)
        for p, q in anchors:
            for step in (1, -1):
                i, j = p + step, q + step
                while i in hx and j in hy and hx[i] == hy[j] and i not in found and j not in taken:
                    found[i] = j
                    taken.add(j)
                    i, j = i + step, j + step
        lo = (-1, -1)
        for p, q in [*anchors, (1 << 62, 1 << 62)]:
            sub = [v for v in x[bisect.bisect_left(x, (lo[0] + 1,)) : bisect.bisect_left(x, (p,))] if v[0] not in found], [v for v in y[bisect.bisect_left(y, (lo[1] + 1,)) : bisect.bisect_left(y, (q,))] if v[0] not in taken]
            if sub[0] and sub[1]:
                todo.append(sub)
            lo = (p, q)
    return sorted(found.items())


def align(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]], min_block: int = MIN_BLOCK) -> list[int]:
    """Places of ``later`` (place, hash, words) to delete: lines in blocks aligned with ``earlier`` (place, hash)."""
    words = {p: w for p, _, w in later}
    a, b, out = [(p, h) for p, h, _ in later], list(earlier), []

    def keep(matched: list[tuple[int, int]]) -> None:
        block: list[int] = []
        before = None
        for p, q in [*matched, (None, None)]:
            if before is None or p is None or (p, q) != (before[0] + 1, before[1] + 1):
                if sum(words[i] for i in block) >= min_block:
                    out.extend(block)
                block = []
            block.append(p)
            before = (p, q)

    while a and b:
        matched = _patience(a, b)
        if not matched:
            break
        keep(matched)
        mine, theirs = {p for p, _ in matched}, {q for _, q in matched}
        a, b = [v for v in a if v[0] not in mine], [v for v in b if v[0] not in theirs]
    # further copies in the later document: runs over all of the earlier one
    at, first = dict(earlier), {h: q for q, h in reversed(earlier)}
    rest: list[tuple[int, int]] = []
    for p, h in a:
        q = rest[-1][1] + 1 if rest and rest[-1][0] + 1 == p else None
        if q is None or at.get(q) != h:
            q = first.get(h)
        if q is not None:
            rest.append((p, q))
    keep(rest)
    return sorted(out)


def _block_table(docs: DataFrame, min_block: int, known=None) -> DataFrame:
    """The block hashes of each document, or with ``known`` the rows of blocks whose bit is set there; nth: how often the document had the block before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                _, _, _, first, h, n = lines(block.column(1))
                h, size, n = blocks(first, h, n, min_block)
                count = np.diff(first)
                doc = np.repeat(np.arange(len(count)), count)
                ok = size > 0
                if known is None:
                    own, doc = h[ok], doc[ok]
                    order = np.lexsort((own, doc))
                    own, doc = own[order], doc[order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
                    own = own[new]
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])
                    continue
                ok &= is_known(known, h)
                place = (np.arange(len(h)) - first[doc])[ok] if len(h) else doc
                doc, h, n = doc[ok], h[ok], n[ok]
                order = np.lexsort((h, doc))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                nth = np.zeros(len(h), np.int32)
                nth[order] = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else 0
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(nth)], ["doc_id", "place", "h", "words", "nth"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "h long" if known is None else "doc_id long, place int, h long, words int, nth int")


def _deletions(docs: DataFrame, min_block: int) -> DataFrame:
    """(doc_id, places, hashes) of the blocks to delete."""
    # hashes that come more than once, by hashes alone; then their rows, most others being left out by a bit table
    known = known_keys(materialize(_block_table(docs, min_block).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")), "h")
    table_ = materialize(_block_table(docs, min_block, known))
    known.destroy()
    first = materialize(table_.groupBy("h").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("last")).where("f != last").select("h", "f"))
    shared = materialize(table_.join(first, "h"))
    discard(table_, first)
    later = shared.where("doc_id != f").select("doc_id", "f", F.lit(0).alias("side"), "place", "h", "words")
    # of the places where the first holder has a block, as many as the later document has: no product of repeats
    holders = shared.where("doc_id = f").select("h", "nth", "place")
    earlier = shared.where("doc_id != f").select("doc_id", "f", "h", "nth").join(holders, ["h", "nth"]).select("doc_id", "f", F.lit(1).alias("side"), "place", "h", F.lit(0).alias("words"))
    # a document's shared blocks meet in one task: at most its own blocks and as many of the documents that hold them first
    rows = later.union(earlier).repartition("doc_id").distinct().sortWithinPartitions("doc_id", "f", "side", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def pair(d: np.ndarray, side: np.ndarray, place: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
            """Numbers of the rows of one pair of documents that go."""
            mid = int(np.searchsorted(side, 1))
            x, y = h[:mid], h[mid:]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            head = int(differ[0]) if len(differ) else n
            differ = np.flatnonzero(x[len(x) - (n - head) :] != y[len(y) - (n - head) :])
            tail = n - head - (int(differ[-1]) + 1 if len(differ) else 0)
            # equal heads and tails are aligned as they stand
            gone = np.zeros(mid, bool)
            gone[:head] = True
            gone[mid - tail :] = True
            if head + tail < mid:
                inner = slice(head, mid - tail)
                left = align(list(zip(place[inner].tolist(), x[inner].tolist(), w[inner].tolist())), list(zip(place[mid:].tolist(), y.tolist())), min_block)
                gone[inner] = np.isin(place[inner], left)
            return np.flatnonzero(gone)

        def pairs(cols: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
            doc, _, side, place, h, w = cols
            own = [i + pair(doc[i:j], side[i:j], place[i:j], h[i:j], w[i:j]) for i, j in zip(ends, ends[1:])]
            at = np.concatenate(own) if own else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(place[at]), pa.array(h[at])], ["doc_id", "place", "h"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            ends = [0, *(np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])) + 1).tolist()]
            yield pairs(rest, ends)
            rest = [c[ends[-1] :] for c in rest]
        if rest is not None and len(rest[0]):
            yield pairs(rest, [0, len(rest[0])])

    gone = rows.mapInArrow(run, "doc_id long, place int, h long")
    return materialize(gone.groupBy("doc_id").agg(F.collect_list("place").alias("_storyspark_places"), F.collect_list("h").alias("_storyspark_hashes")))


def dedup_lines(docs: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """``docs`` with text (and n_chars, where there is such a column) after deletion, and n_lines and n_removed.

    Every document is compared with the earlier (smaller doc_id) documents that first hold one of its blocks. Null texts stay
    null with 0 lines; a text all of whose lines go becomes empty. A null doc_id is not compared. Rows that repeat a
    doc_id are one document (a deletion holds for each row that has that line in that place) and don't delete from each other. Texts of any length are read whole; an empty table gives an
    empty one; other columns pass through, and columns named n_lines or n_removed are replaced.
    """
    docs = without(docs, *COLUMNS, "_storyspark_places", "_storyspark_hashes")
    names = docs.columns
    gone = _deletions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_block)
    gone = gone.withColumnRenamed("doc_id", "_storyspark_doc")
    # the deletions grow with the corpus, so they are never broadcast by hint
    joined = docs.join(gone, docs["doc_id"] == gone["_storyspark_doc"], "left").drop("_storyspark_doc")
    at, chars = names.index("text"), [i for i, x in enumerate(names) if x.lower() == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, names[at]):
                cols = [block.column(i) for i in range(len(names))]
                data, starts, _, first, h, n = lines(cols[at])
                places_, hashes_, removed = block.column(len(names)), block.column(len(names) + 1), [0] * len(block)
                asked = np.flatnonzero(places_.is_valid().to_numpy(zero_copy_only=False)).tolist()
                if not asked:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64())], [*names, *COLUMNS])
                    continue
                h, size, _ = blocks(first, h, n, min_block)
                raw, offs = data.tobytes(), K.buffers(cols[at])[1]
                texts = cols[at].to_pylist()
                for i in asked:
                    places, hashes = places_[i].as_py(), hashes_[i].as_py()
                    own = h[first[i] : first[i + 1]].view(np.int64)
                    drop = np.zeros(len(own), bool)
                    if places:
                        p, q = np.array(places), np.array(hashes)
                        fit = p < len(own)
                        p, q = p[fit], q[fit]
                        p = p[own[p] == q]
                        for step in range(int(size[first[i] + p].max(initial=0))):
                            drop[p[size[first[i] + p] > step] + step] = True
                    removed[i] = int(drop.sum())
                    if removed[i]:
                        cut = np.append(starts[first[i] : first[i + 1]], offs[i + 1])
                        kept = raw[offs[i] : cut[0]] + b"".join(raw[cut[j] : cut[j + 1]] for j in np.flatnonzero(~drop))
                        texts[i] = kept.decode("utf-8").rstrip() if drop[-1] else kept.decode("utf-8")
                cols[at] = pa.array(texts, cols[at].type)
                for c in chars:
                    cols[c] = pa.array([len(t) if r else old for t, r, old in zip(texts, removed, cols[c].to_pylist())], cols[c].type)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first).astype(np.int64)), pa.array(removed, pa.int64())], [*names, *COLUMNS])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{plain}, n_lines long, n_removed long")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
