"""Language identification with error-correcting output codes.

Each language has a codeword; for every bit a binary n-gram classifier (log odds of hashed byte n-grams between the
languages whose bit is 1 and those whose bit is 0) predicts the bit from the whole text. Decoding is loss-weighted: the
logistic losses of all bits against a language's codeword are summed and the language of the least sum wins; a document
whose runner-up is close is flagged ambiguous. The classifiers are fitted on counts over all labelled training rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm import textkernel as K
from storyspark.llm.common import crc_fold, table, text_blocks, without

#: n-gram orders, hash buckets (for all orders together), and pseudo-count of each bucket.
ORDERS = (2, 3, 4)
BUCKETS = 1 << 13
SMOOTH = 1.0
#: A language's n-gram log odds are averaged over a text and count as this many independent n-grams at most.
EVIDENCE = 60.0
#: Posterior below which a decision counts as ambiguous.
AMBIGUOUS = 0.6
FOLDS = 5
UNDETERMINED = "und"
COLUMNS = ("held_out", "lang_pred", "score", "ambiguous")
#: A letter: category L, so neither number signs (½, ②, Ⅷ) nor marks.
_LETTER = regex.compile(r"\p{L}")
_FOLD = K.LOWER.copy()
for _b in range(128):
    if not (65 <= _b <= 90 or 97 <= _b <= 122):
        _FOLD[_b] = 32


def codewords(n: int) -> np.ndarray:
    """Codewords (rows of +1 and -1) of ``n`` languages: exhaustive up to six, else random ones whose least distance is the largest of 64 draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, float).T
    length, best, best_d = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([1.0, -1.0], (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        d = min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(n), 2))
        if d > best_d:
            best, best_d = code, d
    return best


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block of texts and the texts' numbers."""
    data, offs = K.buffers(col)
    b = _FOLD[data].astype(np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    buckets, docs = [], []
    for n in ORDERS:
        if len(b) < n:
            continue
        acc = b[: len(b) - n + 1] + np.uint64(n << 9)
        for j in range(1, n):
            acc = acc * np.uint64(257) + b[j : len(b) - n + 1 + j]
        inside = doc[: len(acc)] == doc[n - 1 :]
        buckets.append(((acc * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)[inside])
        docs.append(doc[: len(acc)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(docs)


def train(labelled: DataFrame) -> dict:
    """The model from ``labelled(text, lang)``: n-gram counts over all rows whose text and lang are not null."""
    schema = "lang string, bucket int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in text_blocks(batch):
                langs = block.column(1).to_pylist()
                names = sorted(set(langs))
                no = np.array([names.index(x) for x in langs], np.int64)
                bucket, doc = _grams(block.column(0))
                sums = np.bincount(no[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for x, s in zip(names, sums):
                    total[x] = total[x] + s if x in total else s
        for x, s in total.items():
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(s[some].astype(np.int64))], ["lang", "bucket", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, schema)
    rows = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS rows at most
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    if langs:
        counts[np.searchsorted(langs, rows.column("lang").to_pylist()), rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    share = counts / counts.sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1] if len(langs) > 1 else 0), np.float32)
    for bit in range(weights.shape[1]):
        weights[:, bit] = np.log(share[code[:, bit] > 0].mean(0)) - np.log(share[code[:, bit] < 0].mean(0))
    return {"langs": langs, "code": code, "weights": weights}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss-weighted decoding of bit margins: the nearest codeword and its share among all by summed loss."""
    loss = np.logaddexp(0, -code[None] * margins[:, None, :]).sum(2) * (len(code) / max(1, 2 * code.shape[1]))
    best = loss.argmin(1)
    soft = np.exp(loss.min(1, keepdims=True) - loss)
    return best, soft[np.arange(len(best)), best] / soft.sum(1)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from the column text alone."""
    docs = without(docs, *COLUMNS[1:])
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in text_blocks(batch, names[at], 256 << 10, 512):
                col, n = block.column(at), block.num_rows
                has = np.array([x is not None and bool(_LETTER.search(x)) for x in col.to_pylist()], bool)
                if len(m["langs"]) > 1:
                    bucket, doc = _grams(col)
                    x = np.bincount(doc.astype(np.int64) * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
                    size = np.maximum(x.sum(1, keepdims=True), 1)
                    best, score = decode((x @ m["weights"]) / size * np.minimum(size, EVIDENCE), m["code"])
                else:
                    best, score = np.zeros(n, np.int64), np.ones(n)
                    has &= bool(m["langs"])
                langs = [m["langs"][b] if ok else UNDETERMINED for b, ok in zip(best, has)]
                score = np.where(has, score, 0.0)
                cols = [block.column(i) for i in range(len(names))] + [pa.array(langs, pa.string()), pa.array(score.astype(float)), pa.array(score < AMBIGUOUS)]
                yield pa.RecordBatch.from_arrays(cols, [*names, "lang_pred", "score", "ambiguous"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{plain}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with held_out, lang_pred, score and ambiguous.

    Learns from the rows whose crc32(doc_id as text) mod ``FOLDS`` is not 0 and whose text and lang are not null (a null
    doc_id is in no fold and is not learnt from). A null text, or one without letters, is ``und`` with score 0; so is every
    text where no row can be learnt from. With one language, all texts with letters get it. Every row is judged, repeated rows alike.
    """
    fold = crc_fold("doc_id", FOLDS)
    model = train(docs.where(fold != 0).select("text", F.col("lang").cast("string").alias("lang")))
    return predict(without(docs, *COLUMNS).withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", *COLUMNS)
