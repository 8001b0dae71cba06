"""Vectorised text primitives on Arrow batches, shared by the operators of this subpackage.

Texts are handled as one array of code points per bounded run of rows, so that a worker's memory follows
``limit`` and the longest single text, never the partition. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SUB_BATCH_CHARS = 2_000_000

U64 = np.uint64


def as_text(column: pa.Array) -> pa.Array:
    """The column as a plain string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free back to the system: workers are reused, by stages that need theirs elsewhere."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def row_runs(column: pa.Array, limit: int = SUB_BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together, or one row that has more."""
    n = len(column)
    if n == 0:
        return
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi
    release()


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and the n + 1 offsets of the texts."""
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(column) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    raw = "".join(column.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), offsets


def sub_batches(column: pa.Array, limit: int = SUB_BATCH_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) for each run of rows."""
    column = as_text(column)
    for lo, hi in row_runs(column, limit):
        codes, offsets = code_points(column.slice(lo, hi - lo))
        yield lo, hi, codes, offsets


@cache
def folded() -> np.ndarray:
    """Code point -> lower-cased letter or digit, 0 for all else; indexed by code point."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low[0])
    return table


#: Classes of kinds(): other, letter in lower case or without case, upper case, digit, space, newline, sentence end, punctuation, symbol.
OTHER, LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, PUNCT, SYMBOL = range(9)


@cache
def kinds() -> np.ndarray:
    """Code point -> one of the nine classes."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        k = unicodedata.category(s)
        if s == "\n":
            table[c] = NEWLINE
        elif s.isspace():
            table[c] = SPACE
        elif k == "Lu" or k == "Lt":
            table[c] = UPPER
        elif k[0] in "LM":
            table[c] = LOWER
        elif k[0] == "N":
            table[c] = DIGIT
        elif s in ".!?…。":
            table[c] = STOP
        elif k[0] == "P":
            table[c] = SYMBOL if s in "#%&*@\\_" else PUNCT
        elif k[0] == "S":
            table[c] = SYMBOL
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an unsigned array."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mix_one(x: int) -> int:
    """mix() of one number."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


_POWERS = [np.ones(1, U64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        out = np.full(size, 0x9E3779B97F4A7C15 | 1, U64)
        out[0] = 1
        _POWERS[0] = np.multiply.accumulate(out)
    return _POWERS[0]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; a run never crosses an offset."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    begin[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; equal spans have equal hashes."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    sizes = ends - starts
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    within = np.arange(total[-1]) - np.repeat(total[:-1], sizes)
    where = within + np.repeat(starts, sizes)
    terms = (codes[where].astype(U64) + U64(1)) * _powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(terms, total[:-1]) + sizes.astype(U64))


def hash_word(word: str) -> int:
    """span_hashes() of one word."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return int(span_hashes(codes, np.array([0]), np.array([len(codes)]))[0])


class HashIndex:
    """Position of each of many 64-bit keys, found for whole arrays at once by linear probing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys).view(U64) if keys.dtype.itemsize == 8 else keys.astype(U64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, q: np.ndarray) -> np.ndarray:
        return ((q * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Index of each query among the keys, -1 where it is absent."""
        q = np.ascontiguousarray(q).view(U64)
        if len(self.keys) == 0:
            return np.full(len(q), -1, np.int32)
        at = self._home(q)
        found = self.slots[at]
        hit = self.keys[found] == q
        rest = np.flatnonzero(~hit & (found >= 0))
        found[~hit] = -1
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            ok = (got >= 0) & (self.keys[got] == q[rest])
            found[rest[ok]] = got[ok]
            on = ~ok & (got >= 0)
            rest, at = rest[on], at[on]
        return found
