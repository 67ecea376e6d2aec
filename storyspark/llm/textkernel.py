"""Vectorised tokenising and hashing of Arrow text columns.

A block of texts is one byte buffer plus offsets. Words are runs of bytes of a class, cut at text borders; a word's
64-bit hash is a polynomial over random byte values, taken from one running sum, so that the cost is a few array
passes per byte. UTF-8 keeps every byte of a non-ASCII character at 0x80 or above, so byte classes are exact for
classes that name ASCII characters only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW = np.ones(1, _U)
_IPOW = np.ones(1, _U)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: [^\x20\x09-\x0D]
NONSPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], _U))[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        k = max(n, 1 << 19)
        for name, base in (("_POW", _BASE), ("_IPOW", _INV)):
            p = np.full(k, base, _U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            globals()[name] = p
    return _POW, _IPOW


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its values; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def runs(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes within each text, and for each text its first run's number (one more entry at the end)."""
    return mask_runs(member[data], offs)


def mask_runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of the places where ``mask`` is true."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def running_hash(data: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """The running sum from which ``spans_of`` takes the hash of any byte span; ``fold`` maps bytes first."""
    values = _BYTES if fold is None else _BYTES[fold]
    total = np.zeros(len(data) + 1, _U)
    own = values[data]
    own *= _powers(len(data) + 1)[0][: len(data)]
    np.cumsum(own, out=total[1:])
    return total


def spans_of(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of the text that ``total`` is of."""
    return mix((total[ends] - total[starts]) * _powers(len(total))[1][starts] + (ends - starts).astype(_U))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """64-bit hash of each byte span; ``fold`` maps bytes first."""
    return spans_of(running_hash(data, fold), starts, ends)


_MULT = [_U(mix_int(k) | 1) for k in range(1, 12)]


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words inside one text, and for each text its first shingle's number."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    out_first = np.concatenate([[0], np.cumsum(counts)])
    if not out_first[-1]:
        return np.zeros(0, _U), out_first
    at = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], counts)
    acc = words[at] * _MULT[0]
    for j in range(1, k):
        acc = mix(acc) + words[at + j] * _MULT[j % 11]
    return mix(acc + _U(k)), out_first
