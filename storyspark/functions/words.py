"""Words of many texts at once, on the bytes of an Arrow column, and their bags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text (or words of token arrays) that are taken at once, and distinct words that a task holds before it hands them on.
BLOCK, HELD = 1 << 23, 1 << 19
#: Kinds of bytes: 1 an ASCII letter or digit, 2 the first byte of what may be a CJK ideograph.
_KIND = np.zeros(256, np.uint8)
for _a, _b in ("09", "AZ", "az"):
    _KIND[ord(_a) : ord(_b) + 1] = 1
_KIND[0xE4:0xEA] = 2


def _split(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    col = texts.cast(pa.large_string()).fill_null("")
    borders = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    borders = borders - borders[0]
    kind = _KIND[data]
    lead = np.flatnonzero(kind == 2)
    kind[lead] = 0
    second, third = (np.take(data, lead + i, mode="clip") if len(lead) else data[:0] for i in (1, 2))
    lead = lead[(lead + 2 < len(data)) & (second >= np.where(data[lead] == 0xE4, 0xB8, 0x80)) & (second < 0xC0) & (third >> 6 == 2)]
    for i in range(3):
        kind[lead + i] = 2
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[borders] = True
    edge = np.flatnonzero(edge)
    start, size = edge[:-1], np.diff(edge)
    used = size >= np.array([len(data) + 1, least, 3 * least])[kind[start]] if len(start) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(size[used])]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[np.repeat(used, size)]))
    return words, np.diff(np.searchsorted(start[used], borders))


def words(col: pa.Array, least: int = 2) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of the rows of a column, row by row, and each row's number of them, in blocks of rows.

    Token arrays are taken as they are. Texts have the tokens of ``plans.dialect.TOKEN`` with ``least`` characters or more.
    Null rows have none.
    """
    listed = pa.types.is_list(col.type) or pa.types.is_large_list(col.type)
    sizes = (pc.list_value_length(col) if listed else pc.binary_length(col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // BLOCK
    at = 0
    for stop in [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(col)]:
        part = col.slice(at, stop - at)
        yield (part.flatten().cast(pa.string()), sizes[at:stop]) if listed else _split(part, least)
        at = stop


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the first column of batches; a word may come again."""
    total = lambda parts: pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
    parts: list[pa.Table] = []
    for batch in batches:
        for found, _ in words(batch.column(0)):
            seen = found.drop_null().value_counts()
            parts.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}))
            if sum(len(p) for p in parts) > 2 * HELD:
                parts = [total(parts)]
                if len(parts[0]) > HELD:
                    yield from parts[0].to_batches()
                    parts = []
    if parts:
        yield from total(parts).to_batches()


def places(col: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the words of a column are in a vocabulary (-1 for others), row by row, and each row's number of words, in blocks of rows."""
    for found, sizes in words(col):
        coded = found.dictionary_encode()
        place = np.append(pc.index_in(coded.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False), -1)
        yield place[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)].astype(np.int64), sizes


def coded(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """The first column of batches as places in a vocabulary (``ids``, a list a row); words that it does not hold are left out."""
    for batch in batches:
        for ids, sizes in places(batch.column(0), vocabulary):
            row, ids = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0], ids[ids >= 0]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32()), pa.array(ids, pa.int32()))], ["ids"])


def bags(col: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """(n_all, n_tokens, bow) a row: its number of words, of those in the vocabulary, and how often it has each of these, as a sparse vector of Spark ML."""
    out = []
    for ids, sizes in places(col, vocabulary):
        row, ids = np.repeat(np.arange(len(sizes)), sizes)[ids >= 0], ids[ids >= 0]
        width = max(len(vocabulary), 1)
        keys, n = np.unique(row * width + ids, return_counts=True)
        ends = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * width), pa.int32())
        rows = [np.zeros(len(sizes), np.int8), np.full(len(sizes), len(vocabulary), np.int32), pa.ListArray.from_arrays(ends, (keys % width).astype(np.int32)), pa.ListArray.from_arrays(ends, n.astype(float))]
        bow = pa.StructArray.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in rows], ["type", "size", "indices", "values"])
        out.append(pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(np.bincount(row, minlength=len(sizes)), pa.int64()), bow], ["n_all", "n_tokens", "bow"]))
    return pa.concat_arrays(out)
