"""Vectorised word and shingle hashing over the UTF-8 buffers of an Arrow string column.

A batch of texts is one byte array; words are runs of bytes other than space and \\t..\\r, so no step loops over
rows or words in Python. Hashes have 64 bits: two different words or shingles fall together with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base), np.uint64)
    if n:
        out[0] = _U(1)
        np.multiply.accumulate(out, out=out)
    return out


_POW = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        _POW[0], _POW[1] = _powers(_P, m), _powers(_P_INV, m)
    return _POW[0], _POW[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the row it is in. A word does not cross rows."""
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][(at[:-1] < len(raw)) & (at[:-1] < at[1:])]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    ends_at = np.zeros(len(raw) + 1, bool)
    ends_at[1:] = inside
    follows = np.zeros(len(raw) + 1, bool)
    follows[:-1] = ~inside
    follows[-1] = True
    follows[edges] = True
    ends = np.flatnonzero(ends_at & follows)
    rows = np.searchsorted(at, starts, "right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each span of bytes that does not depend on where the span stands."""
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw] if lower else raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Bytes hashed at once: bounds the working memory, whatever the length of a text.
PIECE = 1 << 20


def _pieces(raw: np.ndarray, at: np.ndarray):
    """Byte ranges of about PIECE that end between words or rows; one longer word makes a longer range."""
    start = 0
    while start < len(raw):
        end = min(start + PIECE, len(raw))
        if end < len(raw):
            row = int(at[np.searchsorted(at, end, "right") - 1])
            blank = np.flatnonzero(_SPACE[raw[start:end]])
            cut = max(row, start + int(blank[-1]) + 1 if len(blank) else 0)
            while cut <= start:  # a word longer than the range
                blank = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
                row = int(at[np.searchsorted(at, end, "left")])
                cut = min(row, end + int(blank[0])) if len(blank) else (row if row <= end + PIECE else start)
                end = min(end + PIECE, len(raw))
                cut = len(raw) if cut <= start and end == len(raw) else cut
            end = cut
        yield start, end
        start = end


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each row, in order, and the number of words of each row."""
    return hashes_of(*buffers(column), lower)


def hashes_of(raw: np.ndarray, at: np.ndarray, lower: bool = True, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of bytes and row offsets; prefix: only so many bytes of each word."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(at) - 1, np.int64)
    for start, end in _pieces(raw, at):
        first, last = np.searchsorted(at, start, "right") - 1, np.searchsorted(at, end, "left")
        part, own = raw[start:end], np.clip(at[first : last + 1], start, end) - start
        starts, ends, rows = words(part, own)
        found.append(span_hashes(part, starts, ends if prefix is None else np.minimum(ends, starts + prefix), lower))
        counts[first:last] += np.bincount(rows, minlength=last - first)
    return np.concatenate(found), counts


#: A shingle keeps this many bits, so that it sorts in one word with the number of its row among SLICE rows.
SHINGLE_BITS = 52
SLICE = 1 << (64 - SHINGLE_BITS)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (52-bit) of each of at most SLICE rows, ascending, and their number.

    A row of 1 to k - 1 words has one shingle, all of its words; a row without words has none.
    """
    n = len(counts)
    assert n <= SLICE
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not made.sum():
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    rows = np.repeat(np.arange(n, dtype=np.uint64), counts)
    left = np.cumsum(counts).repeat(counts) - np.arange(len(hashes))  # words from here to the row's end
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    value = np.zeros(len(hashes), np.uint64)
    short = np.minimum(counts, k).repeat(counts)
    for i in range(k):
        step = value * _U(0x2545F4914F6CDD1D) + padded[i : i + len(hashes)] + _U(i + 1)
        step ^= step >> _U(29)
        value = step if i == 0 or (counts[counts > 0].min() >= k) else np.where(i < short, step, value)
    value = mix(value)
    starts = left >= short
    key = (value[starts] >> _U(64 - SHINGLE_BITS)) | (rows[starts] << _U(SHINGLE_BITS))
    key.sort()
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << _U(SHINGLE_BITS)) if n < SLICE else np.append(
        np.searchsorted(key, np.arange(n, dtype=np.uint64) << _U(SHINGLE_BITS)), len(key))
    return key & _U((1 << SHINGLE_BITS) - 1), np.diff(at)
