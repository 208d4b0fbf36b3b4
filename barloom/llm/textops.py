"""Vectorised word and shingle hashing over Arrow string columns.

Everything works on the UTF-8 buffer of a string column, so the cost per byte
is a handful of numpy passes and no Python object is made per word.  Hashes
are fixed functions of the bytes: every executor, retry and run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
"""Texts are hashed in slices of about this many bytes (a longer text is one slice)."""

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [U64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(64)]
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of the near-duplicate contract: all but the ASCII white space bytes.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the contamination contract: digits, letters a-z, all non-ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, CHUNK_BYTES + 1024)
        for name, base in (("_pow", _BASE), ("_inv", _BASE_INV)):
            a = np.full(m, base)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow, _inv


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, of one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray):
    """Start, end (bytes), 64-bit hash and row of each lower-cased word.

    ``kind`` says which (lower-cased) bytes belong to words; words end at row ends.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    low = LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[low]
    first = np.zeros(n + 1, bool)
    first[off] = True
    mid = inside[1:-1]
    start = np.flatnonzero(mid & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(mid & (~inside[2:] | first[1:])) + 1
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(off, start, "right") - 1
    return start, end, h, row


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int = 5):
    """Shingle hashes and their row offsets (``rows + 1`` of them).

    A row with fewer than ``width`` words, but not none, has its whole
    sequence as one shingle.  Repeats are kept.
    """
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    word0 = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(off[-1], np.uint64)
    if len(h) >= width:
        m = len(h) - width + 1
        s = np.zeros(m, np.uint64)
        for k in range(width):
            s += h[k : m + k] * _STEP[k]
        whole = row[:m] == row[width - 1 :]
        at = np.flatnonzero(whole)
        out[off[row[at]] + at - word0[row[at]]] = mix(s[at] + U64(width))
    for r in np.flatnonzero((count > 0) & (count < width)):
        w = h[word0[r] : word0[r + 1]]
        s = sum((int(x) * int(_STEP[k]) for k, x in enumerate(w)), len(w))
        out[off[r]] = mix(np.array([s & ((1 << 64) - 1)], np.uint64))[0]
    return out, off
