"""Near duplicates by SimHash with deletion-variant signatures.

Each text gets a 128-bit SimHash of its distinct folded words, weighted by their count up to ``MOST_COUNT``. Without
that bound the frequent words of a language would decide the signature of a long text, and unrelated long texts would
be candidates. Two
signatures that differ in at most ``k`` bits, cut into ``m = k // 2 + 1`` segments, agree in one segment up to at
most one bit. So each segment is indexed by all of its one-wildcard variants (the segment without one bit); an
equality join on (segment, place of the wildcard, other bits) meets every such pair. Equal signatures are joined
first, so that thousands of exact copies are one entry of the index. Within a bucket, each component of the signatures
grows against its unvisited members only, from the smallest signature: no bucket is capped, a tight group of n members
costs about n comparisons and gives n - 1 candidate edges, and its buckets give the same ones. A bucket of more than
``BLOCK`` signatures is compared in pairs of blocks, each in a task of its own, so that no task holds it whole.

Close signatures are no proof. So each candidate edge is verified
on the two texts: the sets of their runs of ``SHINGLE`` words need a Jaccard similarity of ``MIN_JACCARD``. Where a
rejected edge leaves a component of candidates in parts, the texts of these parts are indexed once more and all their
close pairs across parts are verified, so that connectivity stays exact.

Defined results: null and empty texts and texts without letters or digits have no signature and are in no group;
rows with a null ``doc_id`` are not grouped; rows that share a ``doc_id`` are one document; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .tables import column_of, connected, id_side, kept, scope, spare, staged

BITS = 128
MAX_DISTANCE = 11
MOST_COUNT = 16
SHINGLE = 3
MIN_JACCARD = 0.5


def segments(k: int = MAX_DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one must differ by at most one bit."""
    m = k // 2 + 1
    edges = [i * bits // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def signatures(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash as n x 2 unsigned words, number of words) of each text."""
    n = len(offsets) - 1
    low = A.folded()[codes]
    starts, ends = A.word_spans(low > 0, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(doc, minlength=n)
    out = np.zeros((n, 2), A.U64)
    if len(starts) == 0:
        return out, words
    h = A.span_hashes(low, starts, ends)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    weight = np.minimum(tf, MOST_COUNT).astype(np.float32)  # whole numbers: sums do not depend on their order
    present, lead = np.unique(doc, return_index=True)
    stops = np.append(lead[1:], len(h))
    for p, a, b in zip(present, lead, stops):
        total = np.zeros(BITS, np.float64)
        for x in range(a, b, 4096):
            y = min(b, x + 4096)
            pair = np.stack([h[x:y], A.mix(h[x:y] ^ A.U64(0x2545F4914F6CDD1D))], 1)
            bit = np.unpackbits(pair.view(np.uint8).reshape(y - x, 16), axis=1, bitorder="little").astype(np.float32)
            total += 2 * (weight[x:y] @ bit) - weight[x:y].sum()
        out[p] = np.packbits(total > 0, bitorder="little").view(A.U64)
    return out, words


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, codes, offsets in A.sub_batches(batch.column("text")):
            sig, words = signatures(codes, offsets)
            keep = np.flatnonzero(words > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo).take(pa.array(keep)),
                    batch.column("print").slice(lo, hi - lo).take(pa.array(keep)),
                    pa.array(sig[keep, 0].view(np.int64)),
                    pa.array(sig[keep, 1].view(np.int64)),
                ],
                names=["doc_id", "print", "lo", "hi"],
            )


def variant_keys(lo: np.ndarray, hi: np.ndarray, k: int = MAX_DISTANCE) -> np.ndarray:
    """One row per signature, one column per (segment, wildcard): the key of that variant."""
    out = np.empty((len(lo), BITS), np.int64)
    n = 0
    for s, (first, width) in enumerate(segments(k)):
        part = np.zeros(len(lo), A.U64)
        for word, base in ((lo, 0), (hi, 64)):
            a, b = max(first, base), min(first + width, base + 64)
            if a < b:
                bits = (word >> A.U64(a - base)) & A.U64((1 << (b - a)) - 1 if b - a < 64 else 0xFFFFFFFFFFFFFFFF)
                part |= bits << A.U64(a - first)
        for w in range(width):
            rest = part & A.U64(((1 << width) - 1) & ~(1 << w))
            keyed = A.mix(rest + A.U64((n + 1) * 0x9E3779B97F4A7C15 % 2**64)) if width > 40 else rest | A.U64(n << 48)
            out[:, n] = keyed.view(np.int64)
            n += 1
    return out


def _variants(k: int):
    """Every row of (lo, hi, ...) once for each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            for x in range(0, batch.num_rows, 4096):
                part = [c[x : x + 4096] for c in cols]
                key = variant_keys(part[0].view(A.U64), part[1].view(A.U64), k).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.repeat(c, BITS)) for c in part)], names=["key", *batch.schema.names])

    return run


def _grow(lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of one bucket, where an edge is a distance of at most k."""
    left = np.lexsort((hi, lo))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = np.bitwise_count(lo[left] ^ lo[u]) + np.bitwise_count(hi[left] ^ hi[u]) <= k
            got = left[near]
            if len(got):
                left = left[~near]
                a.append(np.full(len(got), u))
                b.append(got)
                front.extend(got)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_edges(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Candidate edges (lo, hi, lo, hi) within the equal keys of sorted arrays of whole buckets."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(edge, len(key)))
    found = []
    least = np.minimum.reduceat(lo, edge) if len(edge) else lo
    some = np.flatnonzero((size > 1) & (size <= 6))
    for n in range(2, 7):
        of = some[size[some] == n]
        if not len(of):
            continue
        i, j = np.triu_indices(n, 1)
        a, b = edge[of][:, None] + i, edge[of][:, None] + j
        near = np.bitwise_count(lo[a] ^ lo[b]) + np.bitwise_count(hi[a] ^ hi[b]) <= k
        low = least[of][:, None]
        near &= ~near.all(1)[:, None] | (lo[a] == low) | (lo[b] == low)  # where all are close, a star is enough
        a, b = a[near], b[near]
        found.append(np.stack([lo[a], hi[a], lo[b], hi[b]], 1))
    for x, n in zip(edge[size > 6], size[size > 6]):
        a, b = _grow(lo[x : x + n], hi[x : x + n], k)
        found.append(np.stack([lo[x + a], hi[x + a], lo[x + b], hi[x + b]], 1))
    return np.concatenate(found) if found else np.zeros((0, 4), A.U64)


def _verify(k: int, most: int | None):
    """Buckets arrive sorted by key; the last one of a batch is carried on to the next.

    Rows are candidate edges (alo, ahi, blo, bhi); a bucket of more than ``most`` signatures is handed over unchanged
    instead, as rows (key, number of the block, lo, hi) that are marked ``hot``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        size, hot, block = 0, None, 0

        def out(rows: np.ndarray, mark: bool) -> pa.RecordBatch:
            rows = rows.view(np.int64)
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)), pa.array(np.full(len(rows), mark))], names=["alo", "ahi", "blo", "bhi", "hot"])

        def done() -> Iterator[pa.RecordBatch]:
            """The edges of what is held, or one more block of a hot bucket."""
            nonlocal held, size, block
            if size:
                key, lo, hi = (np.concatenate(h) for h in held)
                held, size = [[], [], []], 0
                if hot is not None:
                    yield out(np.stack([key, np.full(len(key), block), lo, hi], 1), True)
                    block += 1
                else:
                    e = _bucket_edges(key, lo.view(A.U64), hi.view(A.U64), k)
                    turn = (e[:, 0] > e[:, 2]) | (e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3])
                    e[turn] = e[turn][:, [2, 3, 0, 1]]
                    yield out(np.unique(e, axis=0), False)

        def hold(cols: list[np.ndarray]) -> None:
            nonlocal size
            for h, c in zip(held, cols):
                h.append(c)
            size += len(cols[0])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            start = 0
            if hot is not None:  # the rest of the hot bucket
                start = int(np.searchsorted(cols[0], hot, side="right"))
                hold([c[:start] for c in cols])
                if start < len(cols[0]) or size >= most:
                    yield from done()
                if start == len(cols[0]):
                    continue
                hot = None
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if cut > start or size and held[0][-1][-1] != cols[0][start]:
                hold([c[start : max(cut, start)] for c in cols])
                yield from done()
                start = max(cut, start)
            hold([c[start:] for c in cols])
            if most is not None and size >= most and len(held[0]) and held[0][0][0] == held[0][-1][-1]:
                hot, block = held[0][-1][-1], 0
                yield from done()
        yield from done()

    return run


#: Signatures of one bucket that a task compares at most; a larger one is compared in pairs of blocks, in tasks of their own.
BLOCK = 50_000


def _candidates(keyed: DataFrame, k: int, most: int) -> DataFrame:
    """(alo, ahi, blo, bhi), staged: edges that span the components of each bucket of (key, lo, hi)."""
    kind = "alo bigint, ahi bigint, blo bigint, bhi bigint, hot boolean"
    ends = ["alo", "ahi", "blo", "bhi"]
    found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(k, most), kind).distinct())
    edges, hot = found.where("not hot").select(*ends), found.where("hot")
    if hot.isEmpty():
        return edges
    hot = hot.select(F.col("alo").alias("key"), F.col("ahi").alias("block"), F.col("blo").alias("lo"), F.col("bhi").alias("hi"))
    many = hot.groupBy("key").agg(F.max("block").alias("last"))
    each = hot.join(many, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    more = each.select(pair.alias("key"), "lo", "hi").repartition("key").sortWithinPartitions("key").mapInArrow(_verify(k, None), kind)
    return staged(edges.union(more.select(*ends)).distinct())


def shingles(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes of each text's runs of SHINGLE folded words; a shorter text is one run."""
    low = A.folded()[codes]
    starts, ends = A.word_spans(low > 0, offsets)
    h = A.span_hashes(low, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(doc, minlength=len(offsets) - 1)
    edge = np.append(0, np.cumsum(words))
    place = np.arange(len(h)) - edge[doc]
    key = h.copy()
    for back in range(1, SHINGLE):
        prior = np.zeros(len(h), A.U64)
        prior[back:] = h[:-back]
        prior[place < back] = 0
        key = A.mix(key * A.U64(0x9E3779B97F4A7C15) + prior)
    return [np.unique(key[min(a + SHINGLE, b) - 1 : b]) if a < b else key[:0] for a, b in zip(edge, edge[1:])]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = np.zeros(batch.num_rows)
        b_text = A.as_text(batch.column("b_text"))
        for lo, hi, codes, offsets in A.sub_batches(batch.column("a_text")):
            left = shingles(codes, offsets)
            for x, y, codes, offsets in A.sub_batches(b_text.slice(lo, hi - lo)):
                for i, b in enumerate(shingles(codes, offsets), x):
                    both = len(np.intersect1d(left[i], b, assume_unique=True))
                    same[lo + i] = both / max(1, len(left[i]) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same >= MIN_JACCARD)], names=["a", "b", "near"])


def _compared(text: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, near) of staged pairs (a, a_print, b, b_print) of documents, compared on their texts; staged."""
    ids = id_side(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    needed = text.join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def side(n: str) -> DataFrame:
        return needed.groupBy(F.col("doc_id").alias(n), F.col("print").alias(f"{n}_print")).agg(F.first("text").alias(f"{n}_text"))

    both = pairs.join(side("a"), ["a", "a_print"]).join(side("b"), ["b", "b_print"])
    return staged(both.select("a", "b", "a_text", "b_text").mapInArrow(_compare, "a bigint, b bigint, near boolean"))


def groups(docs: DataFrame, k: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, kept_doc_id) for every document of a group of two or more; the smallest doc_id of the group is kept.

    A group is a component of the graph whose edges join texts with signatures that differ in at most ``k`` bits and
    with a Jaccard similarity of at least ``MIN_JACCARD``.
    """
    with scope():
        return kept(_groups(docs, k, block))


def _groups(docs: DataFrame, k: int, block: int) -> DataFrame:
    text = docs.select(column_of(docs, "doc_id", "bigint"), column_of(docs, "text", "string")).where("doc_id is not null and text is not null")
    text = text.withColumn("print", F.xxhash64("text"))
    signed = staged(text.mapInArrow(_sign, "doc_id bigint, print bigint, lo bigint, hi bigint"))
    nodes = staged(signed.groupBy("lo", "hi", "print").agg(F.min("doc_id").alias("rep")))
    distinct = staged(nodes.groupBy("lo", "hi").agg(F.min(F.struct("rep", "print")).alias("of")).select("lo", "hi", "of.rep", "of.print"))
    keyed = distinct.select("lo", "hi").mapInArrow(_variants(k), "key bigint, lo bigint, hi bigint")
    pairs = _candidates(keyed, k, block)
    a, b = (distinct.select(F.col("lo").alias(f"{n}lo"), F.col("hi").alias(f"{n}hi"), F.col("rep").alias(n), F.col("print").alias(f"{n}_print")) for n in "ab")
    ends = ["a", "a_print", "b", "b_print"]
    named = pairs.join(a, ["alo", "ahi"]).join(b, ["blo", "bhi"]).select(*ends)
    alike = nodes.select("lo", "hi", F.col("rep").alias("a"), F.col("print").alias("a_print")).join(b, (F.col("lo") == F.col("blo")) & (F.col("hi") == F.col("bhi"))).where("a_print <> b_print").select(*ends)
    first = _compared(text, staged(named.union(alike).where("a <> b")))
    copies = signed.join(nodes, ["lo", "hi", "print"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    found = connected(first.where("near").select("a", "b").union(copies))

    # Candidates that rejected edges held together: the parts, and all close pairs of texts across them.
    part = lambda n: found.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    torn = first.where("not near").join(part("a"), "a", "left").join(part("b"), "b", "left")
    torn = staged(torn.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct())
    if not torn.isEmpty():
        parts = id_side(torn.select(F.col("a").alias("part")).union(torn.select(F.col("b").alias("part"))).distinct())
        members = nodes.join(part("rep"), "rep", "left").select("lo", "hi", "rep", "print", F.coalesce("rep_root", "rep").alias("part"))
        members = staged(members.join(parts, "part", "left_semi").select("lo", "hi", "rep", "print", "part"))
        keyed = members.mapInArrow(_variants(k), "key bigint, lo bigint, hi bigint, rep bigint, print bigint, part bigint")
        x, y = keyed.hint("merge").alias("x"), keyed.alias("y")  # Spark takes the rows that Python makes to be as few as it gets
        close = F.bit_count(F.expr("x.lo ^ y.lo")) + F.bit_count(F.expr("x.hi ^ y.hi")) <= k
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & close)
        pairs = pairs.select(F.col("x.rep").alias("a"), F.col("x.print").alias("a_print"), F.col("y.rep").alias("b"), F.col("y.print").alias("b_print"))
        tried = first.where("not near").select("a", "b").union(first.where("not near").select("b", "a"))
        pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti")
        more = _compared(text, staged(pairs)).where("near").select("a", "b")
        found = connected(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return staged(found.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id")))


def near_duplicates(docs: DataFrame, k: int = MAX_DISTANCE) -> DataFrame:
    """groups() without the kept documents: one pair (doc_id, kept_doc_id) for each document that would go."""
    return groups(docs, k).where("doc_id <> kept_doc_id")


def deduplicate(docs: DataFrame, k: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were; what is in no group stays."""
    name = spare("gone", docs)
    gone = id_side(near_duplicates(docs, k).select(F.col("doc_id").alias(name)))
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")
