"""Word vectors by skip-gram with negative sampling, from given vectors on: partitions train apart, and each epoch averages what they learnt.

Spark ML's Word2Vec always starts from chance and learns pair by pair. Here the words that a pretrained table knows start from its vectors, the
others from small seeded ones, and all are trained, on runs of tokens at once. An epoch broadcasts the model (``MODEL_BYTES`` at most, else an
error that asks for a larger ``min_count``); every task trains a copy on its documents and returns the words it touched, which are averaged by
how often each was touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions import words as W
from storyspark.operators.graph_algorithms import cut

#: Bytes of the model that is broadcast and copied by a task.
MODEL_BYTES = 512 << 20
#: Tokens that a task learns from at once (fewer, where that makes less than ``LEAST_RUNS`` of its tokens), successive ones of them that share their
#: negatives, and runs for which these are drawn at once.
RUN, LEAST_RUNS, GROUP, RUNS = 512, 256, 16, 64
#: Mean gradient steps that a word goes in one such step at most.
STEPS = 4
#: Tokens that a task learns from: so many at least, and so many a word, as what it returns is of the vocabulary's size.
TASK_TOKENS, TOKENS_A_WORD = 1 << 22, 8
#: Words of which a task returns the vectors as one row.
ROWS = 4096
#: Power of the counts by which negatives are drawn.
NOISE = 0.75


class TooManyWords(ValueError):
    """The vocabulary's model is larger than ``MODEL_BYTES``."""


@dataclass
class Trained:
    """Vectors (word, vector, known), the mean loss a pair of each epoch, and what was trained on."""

    vectors: DataFrame
    losses: list[float] = field(default_factory=list)
    vocabulary: int = 0
    tokens: int = 0
    known: int = 0


def vocabulary(docs: DataFrame, tokens: str = "tokens", min_count: int = 2) -> DataFrame:
    """(word, n) of the words that occur at least ``min_count`` times."""
    return docs.select(tokens).mapInArrow(W.counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def pairs(ids: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and context of every two words of a document that are at most ``window`` apart, both ways round."""
    a, b = [], []
    for step in range(1, window + 1):
        near = np.flatnonzero(doc[:-step] == doc[step:])
        a += [ids[near], ids[near + step]]
        b += [ids[near + step], ids[near]]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _learn(w_in: np.ndarray, w_out: np.ndarray, ids: np.ndarray, doc: np.ndarray, drawn: np.ndarray, window: int, rate: float, often: np.ndarray) -> tuple[float, int, tuple, tuple]:
    """One step on the words of a run but for ``window`` at both ends (which are context only), with the gradients summed per word.

    A word is the centre of 2 ``window`` pairs at most: the negatives of so many (a row of ``drawn``) are those of a group of successive words, and
    count for each of these by its share of pairs. ``often`` is room for a count a word, zero before and after. Words of a negative ``doc`` fill up
    the last group. Returns the loss before the step, the number of pairs, and for both sides the words touched and how often.
    """
    groups, wide = (len(ids) - 2 * window) // GROUP, GROUP + 2 * window
    around = lambda v: np.lib.stride_tricks.sliding_window_view(v, wide)[::GROUP]
    inner = lambda v: v[window : window + groups * GROUP].reshape(groups, GROUP)
    centre, context, home = inner(ids), around(ids), inner(doc)[:, :, None]
    gap = np.abs(np.arange(wide) - window - np.arange(GROUP)[:, None])
    near = ((gap > 0) & (gap <= window) & (home == around(doc)[:, None]) & (home >= 0)).astype(np.float32)
    met = np.matmul(near, (context[:, :, None] == drawn[:, None]).astype(np.float32))  # a negative that is the context itself does not count
    weight = np.concatenate([near, (near.sum(2, keepdims=True) - met) / np.float32(2 * window)], 2)
    target = np.concatenate([context, drawn], 1)
    x, y = w_in.take(centre, 0), w_out.take(target, 0)
    y[:, wide:] *= -1
    e = np.exp(-np.clip(np.matmul(x, np.ascontiguousarray(y.transpose(0, 2, 1))), -30, 30))
    loss = float(np.vdot(np.log1p(e), weight))
    g = e / (1 + e) * weight
    gx, gy = np.matmul(g, y), np.matmul(g.transpose(0, 2, 1), x)
    gy[:, wide:] *= -1
    sides = (centre.ravel(), near.sum(2).ravel()), (target.ravel(), weight.sum(1).ravel())
    for w, (rows, n), grad in zip((w_in, w_out), sides, (gx, gy)):
        np.add.at(often, rows, n)
        # a word of very many pairs would overshoot: it goes STEPS mean steps at most
        grad = grad.reshape(len(rows), -1) * (np.float32(rate) * np.minimum(1, STEPS / np.maximum(often[rows], 1)))[:, None]
        often[rows] = 0
        np.add.at(w.reshape(-1), (rows[:, None] * w.shape[1] + np.arange(w.shape[1])).ravel(), grad.ravel())
    return loss, int(near.sum()), *sides


#: Rows of up to ``ROWS`` words: which part of the vocabulary, centre or context, the task, and the arrays of words, how often each, and vectors.
BLOBS = "part int, kind int, task int, word binary, n binary, vector binary"


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (None, None, None, np.int32, np.float64, np.float32)
    return pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes() if k else x for x in col], pa.binary() if k else pa.int32()) for k, col in zip(kinds, zip(*rows))], ["part", "kind", "task", "word", "n", "vector"])


def _mean(group: pa.Table) -> pa.Table:
    """The mean vector of each word of a part over the tasks that touched it, by how often they did, always added in the order of tasks."""
    rows = sorted(zip(*group.to_pydict().values()), key=lambda r: r[2])
    word, n, vector = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in ((3, np.int32), (4, np.float64), (5, np.float32)))
    words, at = np.unique(word, return_inverse=True)
    total = np.bincount(at, n)
    mean = np.stack([np.bincount(at, n * v) / total for v in vector.reshape(len(word), -1).T], 1)
    return pa.Table.from_batches([_blobs([(*rows[0][:3], words, total, mean)])])


def train(docs: DataFrame, size: int, pretrained: DataFrame | None = None, tokens: str = "tokens", window: int = 5, min_count: int = 2, epochs: int = 3, negatives: int = 5, rate: float = 0.05, seed: int = 42) -> Trained:
    """Train on ``docs(tokens)``, from ``pretrained(word, vector)`` where that knows a word (vectors of another length than ``size`` are an error).

    ``tokens`` are token arrays, or texts that are split as ``functions.words`` does. The same partitions give the same vectors. ``rate`` falls to
    nothing over all epochs. Null and empty token arrays teach nothing; without a word of the vocabulary the result has no rows. With no epoch the vectors are those to start from.
    """
    spark = docs.sparkSession
    words = cut(vocabulary(docs, tokens, min_count))
    given = pretrained.select("word", F.col("vector").cast("array<double>").alias("vector")).dropDuplicates(["word"]) if pretrained is not None else spark.createDataFrame([], "word string, vector array<double>")
    if not given.where((F.size("vector") != size) & F.col("vector").isNotNull()).isEmpty():
        raise ValueError(f"a given vector has not {size} components")
    n_words = words.count()
    if 8 * n_words * size > MODEL_BYTES:
        raise TooManyWords(f"{n_words} words of {size} components are more than {MODEL_BYTES} bytes: raise min_count")
    table = words.join(given, "word", "left").orderBy("word").toArrow().combine_chunks()  # within MODEL_BYTES
    names, start = (table.column(c).combine_chunks() for c in ("word", "vector"))
    names, counts = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).cast(pa.string()), table.column("n").to_numpy().astype(float)
    known = np.asarray(start.is_valid())
    w_in = ((np.random.default_rng(seed).random((n_words, size)) - 0.5) / size).astype(np.float32)
    if known.any():
        w_in[known] = start.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    w_out = np.zeros((n_words, size), np.float32)
    noise = np.cumsum(counts**NOISE) / max((counts**NOISE).sum(), 1e-300)
    losses: list[float] = []
    if n_words and epochs:
        every = spark.sparkContext.broadcast(names)
        coded = docs.select(tokens).mapInArrow(lambda batches: W.coded(batches, every.value), "ids array<int>")
        # the documents are dealt by how much there is to learn from, however few files hold them
        tasks = max(1, int(counts.sum()) // max(TASK_TOKENS, TOKENS_A_WORD * n_words))
        dealt, share = (cut(coded) if epochs > 1 else coded).repartition(tasks), counts.sum() / tasks
        length = GROUP * int(min(max(share // LEAST_RUNS // GROUP, 1), RUN // GROUP))
    for epoch in range(epochs if n_words else 0):
        shared = spark.sparkContext.broadcast((w_in, w_out, noise))

        def run(batches: Iterator[pa.RecordBatch], epoch=epoch, shared=shared) -> Iterator[pa.RecordBatch]:
            w_in, w_out, noise = shared.value
            w_in, w_out = w_in.copy(), w_out.copy()
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            n_in, n_out, loss, seen, done = *(np.zeros(len(noise)) for _ in range(2)), 0.0, 0, 0
            often = np.zeros(len(noise), np.float32)
            for batch in batches:
                col = batch.column(0)
                ids, size_of = col.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(col.offsets))
                doc = np.repeat(np.arange(len(size_of), dtype=np.int32), size_of)
                ends = window, window + -len(ids) % GROUP
                ids, doc = np.pad(ids, ends), np.pad(doc, ends, constant_values=-1)
                for at in range(0, len(ids) - 2 * window, length):
                    part = slice(at, at + length + 2 * window)
                    if at // length % RUNS == 0:  # the negatives of some runs, sought in order and dealt out
                        drawn = np.searchsorted(noise, np.sort(rng.random(RUNS * length // GROUP * 2 * window * negatives)) * noise[-1]).astype(np.int32).reshape(-1, RUNS * length // GROUP).T
                    mine = drawn[at // GROUP % len(drawn) :][: (len(ids[part]) - 2 * window) // GROUP]
                    cost, n, *both = _learn(w_in, w_out, ids[part], doc[part], mine, window, rate * max(1 - (epoch + min((done + at) / share, 1)) / epochs, 1e-4), often)
                    loss, seen = loss + cost, seen + n
                    for total, (rows, times) in zip((n_in, n_out), both):
                        np.add.at(total, rows, times)
                done += len(ids) - 2 * window
            task = TaskContext.get().partitionId()
            if seen:
                yield _blobs([(-1, 0, task, np.array([-1]), np.array([seen]), np.array([[loss / seen]]))])
            for kind, w, n in ((0, w_in, n_in), (1, w_out, n_out)):
                touched = np.flatnonzero(n)
                for i in np.split(touched, np.flatnonzero(np.diff(touched // ROWS)) + 1):
                    if len(i):
                        yield _blobs([(i[0] // ROWS, kind, task, i, n[i], w[i])])

        rows = dealt.mapInArrow(run, BLOBS).groupBy("part", "kind").applyInArrow(_mean, BLOBS).toArrow()  # two vectors a word at most
        for part, kind, _, word, _, vector in zip(*rows.to_pydict().values()):
            if part < 0:
                losses.append(float(np.frombuffer(vector, np.float32)[0]))
            else:
                (w_in, w_out)[kind][np.frombuffer(word, np.int32)] = np.frombuffer(vector, np.float32).reshape(-1, size)
        shared.unpersist()
    listed = pa.ListArray.from_arrays(pa.array(np.arange(n_words + 1) * size, pa.int32()), pa.array(w_in.ravel(), pa.float64()))
    vectors = spark.createDataFrame(pa.table({"word": names, "vector": listed, "known": pa.array(known)}), "word string, vector array<double>, known boolean")
    return Trained(vectors, losses, n_words, int(counts.sum()), int(known.sum()))
