"""Numpy kernels over Arrow text columns: words, hashes, sliding minima.

Every kernel works on one flat byte buffer that holds several documents, with an
offsets array beside it, and never loops over documents or words in Python.
Strings are hashed as polynomials modulo the prime 2**61 - 1 at a random point,
read off prefix sums; there is a cheaper hash for grouping alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes handled at once; a longer document is handled alone.
CHUNK_BYTES = 1 << 18
#: Stands for a null document id inside the operators: it sorts before all others.
NULL_ID = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of the public SplitMix64 generator."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_values(seed: int = 1) -> np.ndarray:
    """256 random values."""
    return mix(np.arange(256, dtype=U64) + U64(256 * seed + 1))


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] = table[97:123]
    return table


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


#: The prime 2**61 - 1, and a number below it that was drawn at random.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_P, _LOW, _MID = U64(PRIME), U64((1 << 30) - 1), U64((1 << 31) - 1)
#: Values handled at once: what a core's cache holds, and few enough that no sum of parts leaves 64 bits.
_STEP = 1 << 14


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & _P) + (x >> U64(61))
    x -= (x >= _P) * _P
    return x


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low + 2**30 * high modulo 2**61 - 1, of parts that leave room."""
    return reduced(low + (high >> U64(31)) + ((high & _MID) << U64(30)))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below that."""
    if len(a) > _STEP:
        out = np.empty(len(a), U64)
        for i in range(0, len(a), _STEP):
            out[i : i + _STEP] = times(a[i : i + _STEP], b[i : i + _STEP] if b.ndim else b)
        return out
    ah, al, bh, bl = a >> U64(31), a & _MID, b >> U64(31), b & _MID
    cross = ah * bl + al * bh
    return reduced(((ah * bh) << U64(1)) + (cross >> U64(30)) + ((cross & _LOW) << U64(31)) + reduced(al * bl))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, ..., base**n modulo 2**61 - 1, by doubling."""
    out = np.ones(n + 1, U64)
    have = 1
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = times(out[:more], np.asarray(pow(base, have, PRIME), U64))
        have += more
    return out


class Powers:
    """Powers of the bases and of their inverses, kept by a task as long as it runs."""

    ODD = 0x9E3779B97F4A7C15
    BACK = pow(ODD, -1, 2**64)

    def __init__(self):
        self._n = -1
        self.grow(0)

    def grow(self, n: int) -> Powers:
        if n > self._n:
            self._n = n
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, PRIME), n)
            self.up_low, self.up_high = self.up & _LOW, self.up >> U64(30)
            self.odd_up, self.odd_down = (np.multiply.accumulate(np.r_[U64(1), np.full(n, b, U64)]) for b in (self.ODD, self.BACK))
        return self


class Polynomial:
    """Hashes of any span of a value sequence from one prefix sum.

    A span's hash is its polynomial modulo 2**61 - 1 at a random point, mixed:
    two different spans of at most n values collide with a chance of n / 2**61.
    Values are bytes, or any numbers, of which the upper 61 bits count.
    """

    def __init__(self, values: np.ndarray, tables: Powers | None = None):
        n = len(values)
        tables = (tables or Powers()).grow(n)
        self.back = tables.down
        self.sums = np.zeros(n + 1, U64)
        carry = U64(0)
        for a in range(0, n, _STEP):
            part = values[a : a + _STEP]
            b = a + len(part)
            if part.dtype == np.uint8:
                part = part.astype(U64) + U64(1)
                low, high = part * tables.up_low[a:b], part * tables.up_high[a:b]
            else:
                term = times(reduced(part >> U64(3)), tables.up[a:b])
                low, high = term & _LOW, term >> U64(30)
            self.sums[a + 1 : b + 1] = reduced(_joined(np.cumsum(low), np.cumsum(high)) + carry)
            carry = self.sums[b]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end)."""
        return mix(times(reduced(self.sums[end] + (_P - self.sums[start])), self.back[start]))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k values, by its start."""
        at = np.arange(max(0, len(self.sums) - k))
        return self.spans(at, at + k)


class Rolling:
    """Cheap hashes of spans, modulo 2**64: good enough to choose and to group by, never to tell texts apart alone."""

    def __init__(self, values: np.ndarray, tables: Powers | None = None):
        n = len(values)
        tables = (tables or Powers()).grow(n)
        self.back = tables.odd_down
        self.sums = np.zeros(n + 1, U64)
        letters = byte_values()
        for a in range(0, n, _STEP):
            b = min(a + _STEP, n)
            part = letters[values[a:b]] if values.dtype == np.uint8 else values[a:b]
            np.cumsum(part * tables.odd_up[a:b], out=self.sums[a + 1 : b + 1])
            self.sums[a + 1 : b + 1] += self.sums[a]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k values, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by its start."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~space_table()[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
        self.end = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
        #: Word numbers at which each document begins.
        self.offsets = np.searchsorted(self.start, offsets)
        self.data = data

    def hashes(self, lower: bool = False, tables: Powers | None = None) -> np.ndarray:
        poly = Polynomial(lower_table()[self.data] if lower else self.data, tables)
        return poly.spans(self.start, self.end)


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each element, the number of the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] numbers) for every i."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first - start, count)


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs covered by any of the spans."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return start[new], end[last]


def text_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A string (or other) Arrow column over the bytes, without copying."""
    n = len(offsets) - 1
    kind = kind or pa.string()
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    off = offsets.astype(np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def keep_bytes(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The masked bytes of each row, and their offsets."""
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=kept[1:])
    return data[mask], kept[offsets]
