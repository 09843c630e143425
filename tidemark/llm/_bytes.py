"""Vectorised byte helpers shared by the operators of this subpackage.

Texts arrive in Arrow batches; these helpers view them as numpy byte arrays and cut every
batch into slices of a bounded number of bytes, so that the memory of a Python worker
depends on that bound and not on the number or length of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step looks at. Temporary arrays are some 60 times as large.
SLICE_BYTES = 1 << 20

#: The word separators of the contracts: blank and the control characters 9 to 13.
SPACES = bytes([32, 9, 10, 11, 12, 13])

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64); wraps silently."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: 64-bit value of each byte, and the odd base of the polynomial hash with its inverse modulo 2**64.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Cached powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = powers(BASE, 1)
        self.down = powers(BASE_INV, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, n), powers(BASE_INV, n)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """q with q[j] - q[i] equal to the hash of data[i:j] times BASE**-i (see ``span_hash``)."""
    _, down = _POWERS.get(len(data))
    q = np.empty(len(data) + 1, dtype=np.uint64)
    q[0] = 0
    np.cumsum(BYTE_CODE[data] * down, out=q[1:])
    return q


def span_hash(q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds, equal for equal bytes."""
    up, _ = _POWERS.get(len(q))
    return mix64((q[end] - q[start]) * up[start])


def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its len+1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if large else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with at most ``limit`` bytes, or one row that alone has more."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not separators."""
    word = np.empty(len(data) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows a..b-1 of a column set apart by line feeds, and the start of each row in it (and the end)."""
    n = b - a
    lengths = np.diff(offsets[a : b + 1])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(starts[-1]), 10, dtype=np.uint8)
    src = data[offsets[a] : offsets[b]]
    keep = np.ones(len(out), dtype=bool)
    keep[starts[1:] - 1] = False
    out[keep] = src
    return out, starts
