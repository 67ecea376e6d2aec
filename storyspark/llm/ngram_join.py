"""Exact Jaccard self-join of word-shingle sets by universe partitioning and the pigeonhole principle.

Two sets of Jaccard similarity t differ in at most (1 - t) / (1 + t) * (|x| + |y|) tokens. Sizes are cut into bands;
every set is indexed in the band of its own size and, where a larger partner can lie above, in the next one. A band
has one bound H on the difference and hashes the token universe into m segments. A segment of allotment 1 is indexed by
its subset of the set's tokens (it matches when no token differs there), one of allotment 2 also by its one-deletion
neighbourhood (it still matches when one token differs). Allotments that sum to H + 1 + c leave every similar pair at
least c + 1 of match weight, so segments with almost no tokens, whose lists would be long, get allotment 0 in a set
where they weigh at most c together. How many segments get 1 or 2 minimises a cost model of index rows and chance matches.

Sets equal as a whole are one class, and one document of a class is indexed. A row of the index carries the set's size and
a parity sketch, whose distance to another sketch bounds the difference of the sets from below. Within a key of at most
``GROUP`` classes the pairs that their sketches allow are candidates: all of them where they are few, else a spanning
forest first and later those that still join two components of the verified links.

A hot key of more classes is split by deviations instead of being listed in pairs. Let C be any set (here the tokens that most
of some members have), and let a set's deviations be its tokens outside C and the tokens of C that it lacks, r in number. Sets
x and y that share no deviation differ in r(x) + r(y) tokens, so whether they are similar is told by r and the sizes alone, and
each such x is then similar to the member that is best by that sum: it links with it, without another comparison. All other
similar pairs share deviations, so many at least that a prefix of each list of deviations is enough; (C, deviation) is
a key of the next level, held by half of the members or so at most. Members far from C can be similar to far ones only
and go on as a key of their own. Levels end when no key is hot; no pair is lost, whatever C is.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import discard, is_known, known_keys, materialize, table, text_blocks
from storyspark.llm.components import components

#: Ratio of the sizes at a band's two ends.
BAND_RATIO = 1.3
#: Cost model: chance that a token of one set is in an unrelated set, and weight of such matches against an index row.
CHANCE, WEIGHT = 0.05, 1e4
#: Price of index rows where segments of one token are indexed too (their lists can be long).
LONELY = 1.15
#: Classes of a key that one task may compare by their sketches; a key of more is split.
GROUP = 512
#: Members of a hot key whose majority makes the set C (any C gives the same result; it only shapes the split).
CORE_OF = 32
#: Bits of a sketch: a power of two, some times the difference bound, within these limits.
SKETCH_BITS, SKETCH_TIMES = (256, 8192), 3
#: Documents to verify whose ids may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
_U = np.uint64


def _poisson_below(lam: float, k: int) -> float:
    return sum(math.exp(-lam) * lam**i / math.factorial(i) for i in range(k))


@functools.lru_cache(None)
def _edges(largest: int) -> tuple[int, ...]:
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.floor(out[-1] * BAND_RATIO)))
    return tuple(out)


def band_of(size: int) -> int:
    """Number of the band that holds a set size: band b is [edge b, edge b + 1)."""
    return int(np.searchsorted(_edges(1 << max(10, size.bit_length())), size, "right")) - 1


def max_difference(a: int, b: int, num: int, den: int) -> int:
    """Most tokens in which sets of sizes a and b of similarity >= num / den differ."""
    return (den - num) * (a + b) // (den + num)


@functools.lru_cache(None)
def allotment(band: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(segments of allotment 1, of allotment 2, slack c, tokens of a segment that is not almost empty) of a band; no segments where only equal sets are similar.

    The slack covers four standard deviations of the weight that almost empty segments have in a set of the band's least size.
    """
    edges = _edges(1 << 40)
    top = edges[band + 1] - 1
    h = max_difference(top, top, num, den)
    if not h:
        return 0, 0, 0, 0
    best = None
    for small, price in ((2, 1.0), (1, LONELY)):
        for share in (0.0, 0.25, 0.5, 0.75, 1.0):  # of the weight that segments of allotment 2 take
            c = 0
            for _ in range(12):
                twos = round(share * (h + 1 + c) / 2)
                ones = max(0, h + 1 + c - 2 * twos)
                m = ones + twos
                lam = edges[band] / m
                if m == 1 or lam < 1:
                    break
                weight = ones * _poisson_below(lam, small) + 2 * twos * _poisson_below(lam, small + 1)
                c = max(c, math.ceil(weight + 4 * math.sqrt(weight) + 1))
            ones = max(0, h + 1 + c - 2 * twos)
            m = ones + twos
            lam = edges[band] / m
            rows = (ones + twos * (1 + lam)) * price
            chance = WEIGHT * (ones * CHANCE**lam + twos * (1 + lam) * CHANCE ** max(0.0, lam - 1))
            if best is None or rows + chance < best[0]:
                best = (rows + chance, ones, twos, c, small)
    return best[1:]


@functools.lru_cache(None)
def _plan(size: int, num: int, den: int) -> tuple[tuple[int, ...], ...]:
    """(band, ones, twos, c, small) of the bands that a set of ``size`` tokens is indexed in."""
    home = band_of(size)
    bands = [home]
    if den * size >= num * _edges(1 << max(10, (2 * size).bit_length()))[home + 1]:
        bands.append(home + 1)
    return tuple((b, *allotment(b, num, den)) for b in bands)


def token_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and each text's first; a text of fewer than ``k`` words is one shingle."""
    data, offs = K.buffers(col)
    s, e, first = K.runs(data, offs, K.NONSPACE)
    words = K.span_hashes(data, s, e)
    h, at = K.shingles(words, first, k)
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        extra = np.array([K.shingles(words[first[i] : first[i + 1]], np.array([0, n[i]]), int(n[i]))[0][0] + _U(int(n[i])) for i in few], _U)
        h = np.insert(h, at[few], extra)
        grow = np.zeros(len(at), np.int64)
        grow[few + 1] = 1
        at = at + np.cumsum(grow)
    for i in range(len(n)):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[at]


def index_keys(tokens: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of many sets (see ``token_sets``) and the set that each key is of."""
    size = np.diff(first)
    plans = {int(n): _plan(int(n), num, den) for n in np.unique(size) if n}
    value = K.mix(tokens + _U(0x5851F42D4C957F2D))
    keys, owner = [], []
    for role in (0, 1):
        rows = [(plans[n][role] if n and len(plans[n]) > role else (0,) * 5) for n in size.tolist()]
        band, ones, twos, c, small = np.array(rows, np.int64).reshape(-1, 5).T
        m = ones + twos
        use = np.flatnonzero(m)
        if not len(use):
            continue
        base = np.cumsum(m) - m
        doc = np.repeat(use, size[use])
        at = np.arange(len(doc)) + np.repeat(first[use] - (np.cumsum(size[use]) - size[use]), size[use])
        seg = ((tokens[at] >> _U(32)) * m[doc].astype(_U) >> _U(32)).astype(np.int64)
        place = base[doc] + seg
        count = np.bincount(place, minlength=int(m.sum()))
        # a set's tokens are sorted, so those of a segment are neighbours
        ends = np.cumsum(count)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(value[at])])
        total = sums[ends] - sums[ends - count]
        seg_doc = np.repeat(np.arange(len(m)), m)
        number = np.arange(len(count)) - base[seg_doc]
        salt = K.mix(number.astype(_U) + K.mix(band[seg_doc].astype(_U) + _U(1)))
        two = number < twos[seg_doc]
        few = small[seg_doc]
        weigh = np.where(two, 2 * (count < few + 1), 1 * (count < few))
        heavy = np.bincount(seg_doc, weigh, len(m)) > c
        keep = heavy[seg_doc] | (count >= few)
        keys.append(K.mix(total + salt)[keep])
        owner.append(seg_doc[keep])
        if two.any():
            near = two[place] & keep[place] & (heavy[doc] | (count[place] > few[place]))
            keys.append(K.mix(total[place[near]] - value[at[near]] + salt[place[near]]))
            owner.append(doc[near])
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def signatures(tokens: np.ndarray, first: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 63-bit signatures of each set."""
    size = np.diff(first).astype(_U)
    out = []
    for h in (K.mix(tokens + _U(seed * 2 + 1)), K.mix(tokens ^ _U(0xC2B2AE3D27D4EB4F))):
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(h, out=total[1:])
        out.append((K.mix(total[first[1:]] - total[first[:-1]] + size) >> _U(1)).view(np.int64))
    return out[0], out[1]


def sketch_bits(size: int, num: int, den: int) -> int:
    return min(max(SKETCH_BITS[0], 1 << (SKETCH_TIMES * max_difference(size, size, num, den)).bit_length()), SKETCH_BITS[1])


def sketches(tokens: np.ndarray, first: np.ndarray, num: int, den: int) -> list[bytes]:
    """Parity sketch of each set: bit i is the parity of the tokens that are i modulo the number of bits."""
    size = np.diff(first)
    known = {int(n): sketch_bits(int(n), num, den) for n in np.unique(size)}
    bits = np.array([known[n] for n in size.tolist()], np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(size)), size)
    at = base[doc] + (tokens & (bits[doc] - 1).astype(_U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[i:j] for i, j in zip((base[:-1] >> 3).tolist(), (base[1:] >> 3).tolist())]


def _matrix(members: list[bytes]) -> np.ndarray:
    """Sketches folded to the length of the shortest one, a row each (a parity sketch folds by halves)."""
    width = min(map(len, members)) >> 3
    rows = [np.frombuffer(x, _U) for x in members]
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, width), 0) for r in rows])


def allowed(size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs of a group may be similar by sizes and sketches, least difference of each pair)."""
    apart = np.zeros((len(size), len(size)), np.int64)
    for w in range(sketch.shape[1]):
        apart += np.bitwise_count(sketch[:, w, None] ^ sketch[None, :, w])
    apart = np.maximum(apart, np.abs(size[:, None] - size[None, :]))
    ok = apart <= (den - num) * (size[:, None] + size[None, :]) // (den + num)
    np.fill_diagonal(ok, False)
    return ok, apart


def near(n: int, m: int, x: bytes, y: bytes, num: int, den: int) -> bool:
    """``allowed`` of one pair, without arrays."""
    most = max_difference(n, m, num, den)
    if abs(n - m) > most:
        return False
    a, b, short = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    while len(x) * 8 > short or len(y) * 8 > short:
        if len(x) * 8 > short:
            half = len(x) // 2
            a, x = (a >> 8 * half) ^ (a & ((1 << 8 * half) - 1)), x[:half]
        else:
            half = len(y) // 2
            b, y = (b >> 8 * half) ^ (b & ((1 << 8 * half) - 1)), y[:half]
    return (a ^ b).bit_count() <= most


def forest(ok: np.ndarray, apart: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the allowed pairs that grows from the members with most of them along the nearest pairs."""
    degree, out = ok.sum(1), []
    left = degree > 0
    far = np.where(ok, apart, 1 << 40)
    for root in np.argsort(-degree, kind="stable").tolist():
        if not left[root]:
            continue
        left[root] = False
        edge = [root]
        while edge:
            new = np.flatnonzero(left & ok[edge].any(0))
            if not len(new):
                break
            near = np.asarray(edge)[far[np.ix_(edge, new)].argmin(0)]
            out += zip(near.tolist(), new.tolist())
            left[new] = False
            edge = new.tolist()
    return out


def _signed(docs: DataFrame, k: int, seed: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                tokens, first = token_sets(block.column(1), k)
                a, b = signatures(tokens, first, seed)
                n = np.diff(first)
                none = n == 0
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n.astype(np.int64)), pa.array(a, mask=none), pa.array(b, mask=none)], ["doc_id", "n_shingles", "sig", "check"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, sig long, check long")


def _representatives(docs: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without the ids none of whose rows represents its class: copies are not indexed again."""
    own = signed.where("doc_id is not null").join(classes, "sig", "left")
    copies = own.groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("rep"), F.lit(False))).alias("own")).where("not own").select("doc_id")
    copies = materialize(copies)
    return docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")


def _keys(docs: DataFrame, k: int, num: int, den: int, part: tuple[int, int]) -> DataFrame:
    """The index keys of one part of the key space."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text"):
                keys = index_keys(*token_sets(block.column(0), k), num, den)[0]
                if part[1] > 1:
                    keys = keys[(keys >> _U(40)) % _U(part[1]) == part[0]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(index, "key long")


ROWS = "key long, sig long, n int, sketch binary"


def _rows(docs: DataFrame, k: int, num: int, den: int, seed: int, known) -> DataFrame:
    """(key, sig, n, sketch) of the keys whose bit in ``known`` is set; a set that a task meets again soon has no second rows."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in text_blocks(batch, "text"):
                tokens, first = token_sets(block.column(0), k)
                keys, owner = index_keys(tokens, first, num, den)
                ok = is_known(known, keys)
                sig = signatures(tokens, first, seed)[0]
                fresh = np.zeros(len(sig), bool)
                for i, s in enumerate(sig.tolist()):
                    if s not in seen:
                        fresh[i] = True
                        seen.add(s)
                if len(seen) > 1 << 17:
                    seen.clear()
                ok &= fresh[owner]
                keys, owner = keys[ok], owner[ok]
                sketch = pa.array(sketches(tokens, first, num, den), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sig[owner]), pa.array(np.diff(first)[owner].astype(np.int32)), sketch.take(pa.array(owner))], ["key", "sig", "n", "sketch"])

    return docs.select("text").mapInArrow(index, ROWS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, columns but the key) of each key of rows sorted by (key, sig), a row for each sig; keys of one sig are left out."""
    rest: list[list] | None = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        if rest:
            cols = [a + b for a, b in zip(rest, cols)]
        key, sig = cols[0], cols[1]
        at = 0
        starts = np.flatnonzero(np.diff(np.array(key, np.int64))) + 1 if len(key) > 1 else np.zeros(0, np.int64)
        for end in starts.tolist():
            if end - at > 1 and sig[at] != sig[end - 1]:
                yield key[at], [c[at:end] for c in cols[1:]]
            at = end
        rest = [c[at:] for c in cols]
    if rest and len(rest[0]) > 1 and rest[1][0] != rest[1][-1]:
        yield rest[0][0], rest[1:]


def _once(cols: list[list]) -> list[list]:
    keep = [i for i, s in enumerate(cols[0]) if not i or s != cols[0][i - 1]]
    return cols if len(keep) == len(cols[0]) else [[c[i] for i in keep] for c in cols]


def _candidates(rows: DataFrame, num: int, den: int, across: bool) -> DataFrame:
    """(key, a, b) of keys of at most ``GROUP`` classes: pairs a < b with key null, and rows (key, null, null) of keys where a forest stands for the pairs.

    ``across``: rows have a component too, and all allowed pairs of different components come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        dense: list[int] = []

        def flush() -> pa.RecordBatch:
            a, b = [p[0] for p in pairs] + [None] * len(dense), [p[1] for p in pairs] + [None] * len(dense)
            made = pa.RecordBatch.from_arrays([pa.array([None] * len(pairs) + dense, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])
            pairs.clear(), dense.clear()
            return made

        for key, cols in _groups(batches):
            sig, n, sketch, *comp = _once(cols)
            if across and len(set(comp[0])) == 1:
                continue
            if len(sig) == 2 and not across:
                if near(*n, *sketch, num, den):
                    pairs.add((sig[0], sig[1]))
                continue
            ok, apart = allowed(np.array(n, np.int64), _matrix(sketch), num, den)
            if across:
                c = np.array(comp[0], np.int64)
                ok &= c[:, None] != c[None, :]
                found = np.argwhere(np.triu(ok)).tolist()
            elif (edges := int(ok.sum()) // 2) <= 2 * len(sig):
                found = np.argwhere(np.triu(ok)).tolist() if edges else ()
            else:
                found = forest(ok, apart)
                dense.append(key)
            for i, j in found:
                a, b = sig[i], sig[j]
                pairs.add((a, b) if a < b else (b, a))
            if len(pairs) > 100_000:
                yield flush()
        yield flush()

    return rows.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(run, "key long, a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, sigs: DataFrame, k: int, seed: int) -> DataFrame:
    """(sig, text) of the wanted classes: the text of a document that represents the class."""
    wanted = materialize(sigs.distinct().join(classes, "sig").select(F.col("rep").alias("doc_id")))
    ids = wanted.where("doc_id is not null")
    docs_ = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").select("text")
    if not wanted.where("doc_id is null").isEmpty():
        docs_ = docs_.union(docs.where("doc_id is null").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                tokens, first = token_sets(block.column(0), k)
                none = np.diff(first) == 0
                yield pa.RecordBatch.from_arrays([pa.array(signatures(tokens, first, seed)[0], mask=none), block.column(0)], ["sig", "text"])

    out = materialize(docs_.mapInArrow(run, "sig long, text string").where("sig is not null").dropDuplicates(["sig"]))
    discard(wanted)
    return out


def _sets(col: pa.Array, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``token_sets`` of a column in which neighbours of one number in ``same`` are equal, and the set of each row."""
    new = np.ones(len(same), bool)
    new[1:] = same[1:] != same[:-1]
    tokens, first = token_sets(col.take(pa.array(np.flatnonzero(new))), k)
    return tokens, first, np.cumsum(new) - 1


def _compare(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (u, v) whose sets are similar, compared in full."""
    left = texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in text_blocks(batch, "text_a"):
                for block in text_blocks(half, "text_b"):
                    a, b = (block.column(i).to_numpy() for i in (0, 1))
                    ta, fa, ia = _sets(block.column(2), a, k)
                    tb, fb, ib = _sets(block.column(3), b, k)
                    links = []
                    for r, (i, j) in enumerate(zip(ia.tolist(), ib.tolist())):
                        x, y = ta[fa[i] : fa[i + 1]], tb[fb[j] : fb[j + 1]]
                        same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        if den * same >= num * (len(x) + len(y) - same):
                            links.append(r)
                    yield pa.RecordBatch.from_arrays([pa.array(a[links]), pa.array(b[links])], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    texts = _texts(docs, classes, pairs.select("a").union(pairs.select("b")).toDF("sig"), k, seed)
    out = materialize(_compare(pairs, texts, k, num, den))
    discard(texts)
    return out


def _cores(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(key, core, tokens) of hot keys: the tokens that most of ``CORE_OF`` members have; equal sets have one number."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("sig"), "sig")
    some = members.select("key", "sig").withColumn("i", F.row_number().over(order)).where(F.col("i") <= CORE_OF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def made(part: pa.Table) -> tuple[int, int, bytes]:
            tokens, first = token_sets(part.column(1), k)
            token, count = np.unique(tokens, return_counts=True)
            token = token[2 * count > len(first) - 1]
            return part.column(0)[0].as_py(), int(signatures(token, np.array([0, len(token)]), 99)[0][0]), token.tobytes()

        for batch in batches:
            here = pa.Table.from_batches([batch])
            rest = here if rest is None else pa.concat_tables([rest, here])
            key = rest.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            for i, j in zip(ends, ends[1:]):
                row = made(rest.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary()))], ["key", "core", "tokens"])
            rest = rest.slice(ends[-1])
        if rest is not None and len(rest):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made(rest), (pa.int64(), pa.int64(), pa.binary()))], ["key", "core", "tokens"])

    return some.join(texts, "sig").select("key", "text").repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, core long, tokens binary")


def _deviations(members: DataFrame, texts: DataFrame, cores: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(core, sig, n, sketch, dev) of members: dev has a key for each deviation of the set from the core, in one order for all."""
    rows = members.join(texts, "sig").join(cores, "core").select("core", "sig", "tokens", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                tokens, first = token_sets(block.column(3), k)
                dev = []
                for i, (core, own) in enumerate(zip(block.column(0).to_pylist(), block.column(2).to_pylist())):
                    c, x = np.frombuffer(own, _U), tokens[first[i] : first[i + 1]]
                    salt = _U(core & (2**64 - 1))
                    dev.append(np.sort(K.mix(np.concatenate([np.setdiff1d(x, c, True) ^ salt, ~(np.setdiff1d(c, x, True) ^ salt)])).view(np.int64)))
                at = np.concatenate([[0], np.cumsum([len(d) for d in dev])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(dev)))
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(np.diff(first).astype(np.int32)), pa.array(sketches(tokens, first, num, den), pa.binary()), lists], ["core", "sig", "n", "sketch", "dev"])

    return rows.mapInArrow(run, "core long, sig long, n int, sketch binary, dev array<long>")


def _split(rows: DataFrame, hot: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(links, rows of the next level) of hot keys."""
    members = materialize(rows.join(hot, "key", "left_semi").select("key", "sig"))
    texts = _texts(docs, classes, members.select("sig"), k, seed)
    cores = materialize(_cores(members, texts, k))
    members = materialize(members.join(cores.select("key", "core"), "key").select("core", "sig").distinct())
    dev = materialize(_deviations(members, texts, cores.select("core", "tokens").dropDuplicates(["core"]), k, num, den))
    discard(texts, cores)
    # G is (den + num) * r - (den - num) * n: sets without a common deviation are similar if their G sum to 0 at most
    dev = dev.withColumn("r", F.size("dev")).withColumn("G", (den + num) * F.col("r").cast("long") - (den - num) * F.col("n").cast("long"))
    most = F.floor(2 * (den - num) * F.max("n") / (den + num))
    of = dev.groupBy("core").agg(F.min(F.struct("G", "sig")).alias("best"), most.alias("H"), F.greatest(F.percentile_approx("r", 0.5), 2 * most).alias("far"))
    dev = dev.join(materialize(of), "core")
    links = dev.where("G + best.G <= 0 and sig != best.sig").select(F.col("sig").alias("u"), F.col("best.sig").alias("v"))
    shared = F.greatest(F.lit(1), F.ceil((F.col("G") + F.col("best.G")) / (2 * (den + num))))
    some = F.slice("dev", F.lit(1), F.greatest(F.lit(0), F.size("dev") - shared + 1).cast("int"))
    near = dev.where("r <= far + H").select(F.explode(some).alias("key"), "sig", "n", "sketch")
    far = dev.where("r > far").select(F.xxhash64("core").alias("key"), "sig", "n", "sketch")
    return materialize(links), materialize(near.union(far))


def _links(rows: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame:
    """Edges (u, v) between classes whose components are those of all similar pairs."""
    small, links = None, None
    while True:
        hot = materialize(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("key"))
        if hot.isEmpty():
            small = rows if small is None else small.union(rows)
            break
        rest = rows.join(hot, "key", "left_anti")
        small = rest if small is None else small.union(rest)
        more, rows = _split(rows, hot, docs, classes, k, num, den, seed)
        links = more if links is None else links.union(more)

    found = materialize(_candidates(small, num, den, across=False))
    pairs = materialize(found.where("a is not null").select("a", "b").distinct())
    more = _verified(pairs, docs, classes, k, num, den, seed)
    links = more if links is None else links.union(more)
    dense = found.where("a is null").select("key")
    if dense.isEmpty():
        return links
    reach = materialize(components(links))
    mixed = small.join(dense, "key", "left_semi").join(reach, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "sketch", F.coalesce("component", "sig").alias("component"))
    more = _candidates(mixed, num, den, across=True).where("a is not null").select("a", "b").distinct()
    return links.union(_verified(materialize(more.join(pairs, ["a", "b"], "left_anti")), docs, classes, k, num, den, seed))


def similarity_groups(docs: DataFrame, k: int = 3, similarity: tuple[int, int] = (90, 100), rounds: int = 1) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    Tokens are distinct ``k``-word shingles of the text with A-Z lower-cased; fewer words are one shingle; null, empty or
    blank texts have no tokens and link with nothing (component_id is then doc_id). Two documents link when
    intersection / union >= similarity; component_id is the smallest doc_id reachable by links. A row whose doc_id is null takes
    part through its text, and its own id is never a component's smallest one (a component of such rows alone has none). Repeated
    rows come out as often as they came in; an empty table gives an empty one; other columns are not read. Whole texts of any
    length are compared. The key space is counted in ``rounds`` parts, one after the other, which divides the disk that
    counting takes and changes nothing else.
    """
    num, den = similarity
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in range(8):
        signed = materialize(_signed(docs, k, seed))
        classes = materialize(signed.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("check").alias("lo"), F.max("check").alias("hi")))
        if classes.where("lo != hi").isEmpty():  # two different sets under one 63-bit signature: another seed
            break
        discard(signed, classes)
    classes = classes.select("sig", "rep")
    own = _representatives(docs, signed, classes)

    # keys of two documents at least, by keys alone; then their rows, most others being left out by a bit table
    lists = None
    for r in range(rounds):
        some = materialize(_keys(own, k, num, den, (r, rounds)).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        lists = some if lists is None else lists.union(some)
    known = known_keys(lists, "key")
    rows = materialize(_rows(own, k, num, den, seed, known))
    reach = materialize(components(_links(rows, own, classes, k, num, den, seed)))
    known.destroy()
    discard(rows)

    named = classes.join(reach, F.col("sig") == F.col("node"), "left").select("sig", "rep", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = materialize(named.join(least, "component").select("sig", "component_id"))
    return signed.select("doc_id", "n_shingles", "sig").join(label, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, similarity: tuple[int, int] = (90, 100), rounds: int = 1) -> DataFrame:
    """The rows of ``docs``, in all their columns, that stay when one document of each group stays: that of the smallest doc_id.

    Of rows that repeat an id one stays; rows whose id is null stay.
    """
    groups = materialize(similarity_groups(docs, k, similarity, rounds))
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    n = gone.count()
    out = docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, "doc_id", "left_anti")
    again = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"))
