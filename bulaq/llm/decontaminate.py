"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are all runs of ``window`` folded words of the benchmark items (an item with fewer words is one
pattern). A shift table over blocks of the text skips positions at which no pattern can end, the hash of a
pattern's suffix selects a bucket of test strings where the shift is 0, and comparison of every symbol confirms.
Many cursors scan a batch at once, each over its own stretch, so that the scan is array arithmetic. Patterns shorter
than ``SHORT`` symbols have tables of their own, so that a short item does not shorten the shifts of all others.

Texts are compared as lower-cased runs of letters and digits with one separator between words; matches begin and
end at words and never cross a text. Defined results: null or empty texts and items match nothing; a null id stays
null in the result; each input row is searched by itself, so repeated rows and items give repeated results; an
empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import column_of, extended

WINDOW = 8
#: Symbols of benchmark text that one broadcast automaton may hold; more items are searched in several passes.
AUTOMATON_SYMBOLS = 20_000_000
SHORT = 24
BOUNDARY = 1


def stream(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts with one 0 around each word and a boundary before each text; boundary positions."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros(len(codes) + 3 * n + 2, np.uint32)
    where = np.arange(len(codes)) + np.repeat(3 * np.arange(n) + 3, size)
    out[where] = A.folded()[codes]
    out[offsets[:-1] + 3 * np.arange(n) + 1] = BOUNDARY
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    keep[0] = True
    out = out[keep]
    return out, np.flatnonzero(out == BOUNDARY)


def patterns(text: str, window: int = WINDOW) -> list[np.ndarray]:
    """Distinct patterns of one item."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s, boundary = stream(codes, np.array([0, len(codes)]))
    s = s[boundary[0] + 1 :]
    gap = np.flatnonzero(s == 0)
    words = len(gap) - 1
    if words < 1:
        return []
    n = min(window, words)
    return list({p.tobytes(): p for p in (s[gap[i] : gap[i + n] + 1] for i in range(words - n + 1))}.values())


class WuManber:
    """Shift table, suffix buckets and test strings of a set of patterns."""

    def __init__(self, pats: list[np.ndarray], items: list[int]):
        self.sizes = np.array([len(p) for p in pats], np.int64)
        self.m = int(self.sizes.min()) if pats else 0
        self.items = np.array(items, np.int64)
        if not pats:
            return
        self.b = min(6, self.m)
        self.flat = np.concatenate(pats)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = 20
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.uint16 if self.m > 250 else np.uint8)
        small = self._small(self.flat)
        for j in range(self.b - 1, self.m):
            h = self._block(small, self.starts + j)
            np.minimum.at(self.shift, h, self.m - 1 - j)
        self.tail = min(self.m, 20)
        suffix = self._tail_hash(self.flat, self.starts + self.m - 1)
        order = np.argsort(suffix, kind="stable")
        keys, first = np.unique(suffix[order], return_index=True)
        self.order = order
        self.first = np.append(first, len(order))
        self.index = A.HashIndex(keys)

    @staticmethod
    def _small(symbols: np.ndarray) -> np.ndarray:
        return ((symbols * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)

    def _block(self, small: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = small[end].astype(np.uint32)
        for i in range(1, self.b):
            h = h * np.uint32(0x01000193) + small[end - i]
        h *= np.uint32(0x9E3779B1)
        return h >> np.uint32(32 - self.bits)

    def _tail_hash(self, symbols: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.zeros(len(end), A.U64)
        for i in range(self.tail):
            h = h * A.U64(0x100000001B3) + symbols[end - i].astype(A.U64)
        return A.mix(h)

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first symbol, pattern) of all occurrences."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(symbols)
        if self.m == 0 or n < self.m:
            return none
        small = self._small(symbols)
        lanes = max(1, min(16384, n // 64))
        edge = np.linspace(self.m - 1, n, lanes + 1).astype(np.int64)
        at, stop = edge[:-1].copy(), edge[1:]
        ends = []
        while len(at):
            step = self.shift[self._block(small, at)].astype(np.int64)
            hit = step == 0
            if hit.any():
                ends.append(at[hit])
                step[hit] = 1
            at = at + step
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        if not ends:
            return none
        end = np.concatenate(ends)
        bucket = self.index.find(self._tail_hash(symbols, end))
        end, bucket = end[bucket >= 0], bucket[bucket >= 0]
        width = self.first[bucket + 1] - self.first[bucket]
        total = np.cumsum(width)
        within = np.arange(total[-1] if len(total) else 0) - np.repeat(total - width, width)
        pat = self.order[np.repeat(self.first[bucket], width) + within]
        pos = np.repeat(end, width) - self.m + 1
        fits = pos + self.sizes[pat] <= n
        pos, pat = pos[fits], pat[fits]
        for i in range(int(self.sizes.max())):
            size = self.sizes[pat]
            inside = i < size
            same = np.ones(len(pat), bool)
            same[inside] = symbols[pos[inside] + i] == self.flat[self.starts[pat[inside]] + i]
            if not same.all():
                pos, pat = pos[same], pat[same]
            if not len(pos) or not inside.any():
                break
        return pos, pat


class Machine:
    """The tables of the short patterns and those of the others; ``items`` has the item of each pattern of both."""

    def __init__(self, pats: list[np.ndarray], items: list[int]):
        short = [i for i, p in enumerate(pats) if len(p) < SHORT]
        long = [i for i, p in enumerate(pats) if len(p) >= SHORT]
        self.parts = [(WuManber([pats[i] for i in of], [items[i] for i in of]), np.array(of, np.int64)) for of in (short, long) if of]
        self.items = np.array(items, np.int64)

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [(pos, of[pat]) for wm, of in self.parts for pos, pat in [wm.search(symbols)]]
        return (np.concatenate([p for p, _ in got]), np.concatenate([p for _, p in got])) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _automata(benchmark: DataFrame, window: int, most: int):
    """One automaton for each part of the benchmark of at most about ``most`` symbols."""
    items = benchmark.select(column_of(benchmark, "item_id", "bigint"), column_of(benchmark, "text", "string"))
    symbols = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(symbols * window // (most * 4)) + 1
    for part in range(parts):
        of = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        pats, owner, ids = [], [], []
        for row in of.toLocalIterator():
            for p in patterns(row["text"], window):
                pats.append(p)
                owner.append(len(ids))
            ids.append(row["item_id"])
        yield Machine(pats, owner), ids


def _hits(machine: Machine, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, distinct patterns of the item found) for all texts and items with a match."""
    symbols, boundary = stream(codes, offsets)
    pos, pat = machine.search(symbols)
    doc = np.searchsorted(boundary, pos, side="right") - 1
    seen = np.unique(np.stack([doc, pat], 1), axis=0)
    pairs, n = np.unique(np.stack([seen[:, 0], machine.items[seen[:, 1]]], 1), axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], n


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_symbols: int = AUTOMATON_SYMBOLS) -> DataFrame:
    """(doc_id, item_id, windows): items of which a row's text holds a pattern, with the number of distinct ones."""
    text = docs.select(column_of(docs, "doc_id", "bigint"), column_of(docs, "text", "string"))
    out = None
    for machine, ids in _automata(benchmark, window, automaton_symbols):
        shared = docs.sparkSession.sparkContext.broadcast((machine, ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            wm, item_ids = shared.value
            names = pa.array(item_ids, pa.int64())
            for batch in batches:
                for lo, hi, codes, offsets in A.sub_batches(batch.column("text")):
                    doc, item, n = _hits(wm, codes, offsets)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), names.take(pa.array(item)), pa.array(n.astype(np.int64))],
                        names=["doc_id", "item_id", "windows"],
                    )

        part = text.mapInArrow(run, "doc_id bigint, item_id bigint, windows bigint")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_symbols: int = AUTOMATON_SYMBOLS) -> DataFrame:
    """``docs`` without the rows whose text holds a pattern of any item; columns as they were."""
    for machine, _ in _automata(benchmark, window, automaton_symbols):
        schema, names = extended(docs, {"clean": T.BooleanType()})
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, hi, codes, offsets in A.sub_batches(batch.column("text")):
                    clean[lo + _hits(shared.value, codes, offsets)[0]] = False
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean)], names=schema.fieldNames())

        docs = docs.mapInArrow(run, schema).where(F.col(names["clean"])).drop(names["clean"])
    return docs


def matches_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for matches() over documents and benchmark."""
    norm = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    return f"""
    WITH items AS (SELECT row_number() OVER () AS r, item_id, string_split({norm}, ' ') AS w FROM benchmark WHERE {norm} <> ''),
    pats AS (
      SELECT DISTINCT r, item_id, ' ' || array_to_string(list_slice(w, i, i + least({window}, len(w)) - 1), ' ') || ' ' AS p
      FROM (SELECT r, item_id, w, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM items)),
    texts AS (SELECT row_number() OVER () AS d, doc_id, ' ' || {norm} || ' ' AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, item_id, count(*) AS windows FROM texts, pats WHERE contains(t, p) GROUP BY d, doc_id, r, item_id"""
