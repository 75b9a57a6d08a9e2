"""Vectorised words and word hashes over Arrow string columns.

A word is a run of bytes other than ``\\x20 \\x09-\\x0D``. These separators are
single bytes in UTF-8, so whole batches are cut and hashed as byte arrays, with
no Python object per word. Hashes are polynomials modulo 2**64 over a random
byte table, evaluated for all words at once from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\r\x0b\x0c"
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    values = np.random.RandomState(7919).randint(1, 1 << 62, 256).astype(U64) * U64(3) + U64(1)
    lowered = values.copy()
    lowered[65:91] = values[97:123]
    return space, values, lowered


IS_SPACE, _VALUES, _LOWERED = _byte_tables()
#: ASCII bytes other than letters and digits: they part the words of ``pieces(..., marks=True)``.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        if size > 2 * _PIECE:
            _powers.pop(max(_powers, default=0), None)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` consecutive items."""
    n = len(hashes)
    if n < width:
        return np.empty(0, U64)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1])


class Piece(NamedTuple):
    """Documents ``first`` to ``last`` of a batch: words of document i are bounds[i]:bounds[i+1]."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWERED if lower else _VALUES)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def _spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~parts[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte runs starts[i]:ends[i], both rising; long data is hashed in pieces cut between runs."""
    if len(data) <= 2 * _PIECE:
        return _hashed(data, starts, ends, lower)
    parts, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE)))
        low = starts[at]
        parts.append(_hashed(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low, lower))
        at = to
    return np.concatenate(parts) if parts else np.empty(0, U64)


def _one(data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = _spans(data, offsets, separators)
    return starts, ends, hash_spans(data, starts, ends, lower)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings, nulls as empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column: pa.Array, lower: bool = False, marks: bool = False) -> Iterator[Piece]:
    """Cuts a string column into pieces of about 1 MB of whole documents; with ``marks``, ASCII punctuation parts words too."""
    column = texts_of(column)
    n = len(column)
    if not n:
        return
    _, place, body = column.buffers()
    offsets = np.frombuffer(place, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE, "right")) - 1)
        last = min(last, n)
        own = data[offsets[first] : offsets[last]]
        local = offsets[first : last + 1] - offsets[first]
        starts, ends, hashes = _one(own, local, lower, IS_MARK if marks else IS_SPACE)
        yield Piece(first, last, own, starts, ends, hashes, np.searchsorted(starts, local), local)
        first = last
