"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass over a trie of the distinct marked words.

A marked word is a word with the marks (spaces) before it. The distinct ones of a run of texts are sorted, which
lays out their trie in depth-first order: a word keeps the forward states of the prefix it shares with the word
before and computes only the rest. For a unigram model the state of a prefix is its best score and last piece. A
merge (BPE) model has no additive scores; there the state is the one last piece with which the prefix's encoding
ends: a sequence of pieces is the merge result if and only if each two neighbours stay apart when merged, so the
state is the piece that stays apart from the state before it. Both give what the model's own library gives.

Defined results: a null text gives null ids, an empty one none; characters that the model lacks become byte pieces,
or the unknown piece if it has none; a mark character in a text reads as a space; decoding gives back the text, but
for that character and for unknown pieces; repeated rows are encoded alike; an empty table gives an empty result;
other columns are carried along, and result columns whose names are taken get underscores.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import extended

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words, and characters of them, whose ids a worker remembers between runs of texts; beyond, it forgets them and goes on.
REMEMBERED = 300_000
REMEMBERED_CHARS = 8_000_000
#: Bytes of text of which the distinct words share one trie.
RUN_BYTES = 2_000_000
_FAR = 1 << 40
_SPLIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def _packed(ids: Iterable[int]) -> bytes:
    """Ids as four bytes each: a remembered word takes half the memory of a tuple."""
    return array("i", ids).tobytes()


class Encoder:
    """Pieces with scores; ``merges`` says whether they are merge ranks or unigram log-probabilities."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], unknown: int, merges: bool = True):
        self.pieces, self.scores, self.special, self.unknown, self.merges = pieces, scores, special, unknown, merges
        self.halves: dict[str, tuple[str, str]] = {}
        self._prepare()

    def __getstate__(self):
        return self.pieces, self.scores, self.special, self.unknown, self.merges, self.halves

    def __setstate__(self, state):
        self.pieces, self.scores, self.special, self.unknown, self.merges, self.halves = state
        self._prepare()

    def _prepare(self) -> None:
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
        skip = self.special | set(self.bytes.values())
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        order = sorted((i for i in self.ids.values() if len(self.pieces[i]) > 1), key=lambda i: (-self.scores[i], i))
        self.rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.marks = [p for p in self.ids if set(p) == {MARK}]
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                tails.setdefault(p[-3:], {2}).add(len(p))
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.pairs = (2,)
        if not self.halves:
            for p in self.rank:
                self._half(p)
        #: Pieces that merging their own characters gives
        self.whole = {p for p, half in self.halves.items() if half[0]}
        self.starts = {p[:i] for p in self.whole for i in range(1, len(p) + 1)}
        self.nodes: dict[str, tuple] = {}
        self.apart: dict[str, dict[str, bool]] = {}
        self.known: dict[str, bytes] = {}
        self.chars = 0
        self.table: dict[str, tuple[int, ...]] = {}
        table = []
        for i, p in enumerate(self.pieces):
            table.append(b"" if i in self.special and i != self.unknown else " ⁇ ".encode() if i == self.unknown else p.replace(MARK, " ").encode())
        for b, i in self.bytes.items():
            table[i] = bytes([b])
        self.raw = table

    def _half(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge made ``piece``."""
        got = self.halves.get(piece)
        if got is None:
            parts, limit = list(piece), self.rank[piece]
            while len(parts) > 2:
                best, where = _FAR, -1
                for i in range(len(parts) - 1):
                    r = self.rank.get(parts[i] + parts[i + 1], _FAR)
                    if r < best:
                        best, where = r, i
                if where < 0 or best >= limit:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            got = self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return got

    def _stay(self, a: str, b: str) -> bool:
        """Whether the neighbours ``a`` and ``b`` are what merging their characters gives."""
        limit, rank = _FAR, self.rank
        while True:
            m = rank.get(a + b)
            if m is not None and m < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                limit, a = ra, self._half(a)[1]
            elif rb >= 0:
                limit, b = rb + 1, self._half(b)[0]
            else:
                return True
            if not a or not b:
                return False

    def _step(self, node: tuple, c: str) -> tuple:
        """Node of the longest suffix that begins a piece; with it the pieces that end here, longest first."""
        at = node[2] + c
        while at not in self.starts and at:
            at = at[1:]
        got = self.nodes.get(at)
        if got is None:
            ends = tuple((size, at[-size:]) for size in range(len(at), 1, -1) if at[-size:] in self.whole)
            got = self.nodes[at] = ({}, ends, at)
        node[0][c] = got
        return got

    def _merge_states(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, last piece of each prefix) in sorted order; states of a shared prefix are kept."""
        apart, stay = self.apart, self._stay
        first = apart.setdefault("", {})
        last, near, nodes = [""], [first], [self.nodes.setdefault("", ({}, (), ""))]
        before = ""
        for w in words:
            i = len(commonprefix((before, w)))
            del last[i + 1 :], near[i + 1 :], nodes[i + 1 :]
            node = nodes[-1]
            for c in w[i:]:
                node = node[0].get(c) or self._step(node, c)
                for size, p in node[1]:
                    of = near[-size]
                    ok = of.get(p)
                    if ok is None:
                        ok = of[p] = of is first or stay(last[-size], p)
                    if ok:
                        break
                else:
                    p = c
                last.append(p)
                of = apart.get(p)
                if of is None:
                    of = apart[p] = {}
                near.append(of)
                nodes.append(node)
            yield w, last
            before = w

    def _score_states(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, last piece of the best path to each prefix) in sorted order, by unigram scores."""
        last, score, before = [""], [0.0], ""
        low = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        for w in words:
            i, m = 0, min(len(w), len(before))
            while i < m and w[i] == before[i]:
                i += 1
            del last[i + 1 :], score[i + 1 :]
            for e in range(i + 1, len(w) + 1):
                c = w[e - 1]
                best, p = score[e - 1] + (self.scores[self.ids[c]] if c in self.ids else low), c
                for size in self.tails.get(w[e - 3 : e], self.pairs) if e > 2 else self.pairs:
                    if size <= e and (q := self.ids.get(w[e - size : e])) is not None and score[e - size] + self.scores[q] > best:
                        best, p = score[e - size] + self.scores[q], w[e - size : e]
                last.append(p)
                score.append(best)
            yield w, last
            before = w

    def _id(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        if i is not None:
            return (i,)
        return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet."""
        known, ids = self.known, self.ids
        plain, marked = [], {}
        double = MARK + MARK
        for w in words:
            if w in known:
                continue
            if not self.merges or not (w.startswith(double) or w == MARK):
                plain.append(w)
            else:  # all marks but the last one are a run of their own, unless the last stays alone too
                marked[w] = MARK + w.lstrip(MARK)
        plain.extend(set(marked.values()) - {MARK})
        plain.sort()
        table = self.table
        for w, last in (self._merge_states if self.merges else self._score_states)(plain):
            e, got = len(w), []
            while e:
                p = last[e]
                i = table.get(p)
                if i is None:
                    i = table[p] = self._id(p)
                got.append(i)
                e -= len(p)
            got.reverse()
            known[w] = _packed(chain.from_iterable(got))
            self.chars += len(w)
        lone = _packed([ids[MARK]]) if MARK in ids else None
        for w, word in marked.items():
            extra = len(w) - len(word)
            own = b"" if word == MARK else known[word]
            if word == MARK or own[:4] == lone:
                extra, own = extra + 1, own[4:]
            known[w] = _packed(chain.from_iterable(map(self._id, self._mark_run(extra)))) + own

    def _mark_run(self, n: int) -> list[str]:
        """Pieces of a run of marks: merges of equal rank, always the leftmost that there is."""
        stack: list[int] = []
        sizes = {len(p) for p in self.marks}
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in sizes:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [MARK * size for size in stack]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The collector of cycles rests meanwhile: nothing here makes any, and it costs half the time."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            split = [_SPLIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
            distinct = set().union(*split)
            if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
                self.known.clear()
                self.chars = 0
            self.learn(distinct)
            known = self.known.__getitem__
            return [np.frombuffer(b"".join(map(known, words)), np.int32) for words in split]
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a serialised message: numbers, and the bytes of what has a length."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, raw[at : at + size]
        at += size


def is_merges(raw: bytes) -> bool:
    """Whether a serialised model is of merges (type 2) rather than of unigram scores (type 1, also where none is given)."""
    kind = 1
    for field, trainer in _fields(raw):
        if field == 2:
            kind = next((v for f, v in _fields(trainer) if f == 3), kind)
    if kind not in (1, 2):
        raise ValueError("only unigram and merge models can be read")
    return kind == 2


def load(path: str = MODEL) -> Encoder:
    """The pieces of a model file, of merges or unigram scores as the file says; nothing of it is copied elsewhere."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = sp.get_piece_size()
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return Encoder([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], special, sp.unk_id(), is_merges(raw))


def encode(docs: DataFrame, path: str = MODEL, check: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``ids``, ``n_tokens`` and, if ``check``, ``lossless``: whether decoding gave the text back; the names of those columns."""
    extra = {"ids": T.ArrayType(T.IntegerType(), False), "n_tokens": T.LongType()} | ({"lossless": T.BooleanType()} if check else {})
    schema, names = extended(docs, extra)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            text = A.as_text(batch.column(at))
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in A.row_runs(text, RUN_BYTES):
                texts = text.slice(lo, hi - lo).to_pylist()
                got = encoder.encode(texts)
                size = np.array([len(g) for g in got], np.int64)
                offsets = np.zeros(len(got) + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                mask = null[lo:hi]
                flat = np.concatenate(got) if got else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(mask))
                cols = [*batch.slice(lo, hi - lo).columns, ids, pa.array(size, mask=mask)]
                if check:
                    cols.append(pa.array([encoder.decode(g.tolist()) == t for g, t in zip(got, texts)], pa.bool_(), mask=mask))
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names


def decode(df: DataFrame, path: str = MODEL, column: str = "ids") -> tuple[DataFrame, str]:
    """``df`` with the text of the ids in ``column``, null for null, and the name of that column."""
    schema, names = extended(df, {"decoded": T.StringType()})
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if ids is None else shared.value.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema), names["decoded"]
