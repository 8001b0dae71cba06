"""Token ids as directly addressable codes: chunk levels with continuation bitmaps and rank directories.

An id is cut into chunks of ``bits`` bits, lowest first. Level 0 holds the first chunk of every id; a bitmap marks
the ids that go on, whose next chunks form level 1 in the same order, and so on. The number of set bits before a
position, from a directory of one count per 512 bits and at most eight words, is the position on the next level, so
any token is read by a few look-ups and no block is decoded.

Layout, little-endian: "DAC1", bits (u1), levels (u1), reserved (u2), tokens (u4); then for each level: entries (u4),
the chunks (u1 or u2 each, padded to 8 bytes), and on all levels but the last the bitmap (u8 words) and its
directory (u4 each, padded to 8 bytes).

Defined results: a null text or null ids give null, an empty text a code without tokens; a negative id or one of
more than 32 bits is an error; repeated rows get equal codes; an empty table gives an empty result; other columns
are carried along, and result columns whose names are taken get underscores.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import extended

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of byte-level BPE as published with that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BITS = 8
SAMPLE = 512
_PAD = (b"", b"\0" * 7, b"\0" * 6, b"\0" * 5, b"\0" * 4, b"\0" * 3, b"\0" * 2, b"\0")


def _padded(raw: bytes) -> bytes:
    return raw + _PAD[len(raw) % 8]


def pack(ids: np.ndarray, bits: int = BITS) -> bytes:
    """The code of a sequence of ids; ``bits`` is 8 or 16."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> 32):
        raise ValueError("ids must fit 32 bits")
    kind = np.dtype("<u1") if bits == 8 else np.dtype("<u2")
    parts, level, rest = [], 0, ids
    while True:
        parts.append(len(rest).to_bytes(4, "little") + b"\0" * 4)
        parts.append(_padded((rest & ((1 << bits) - 1)).astype(kind).tobytes()))
        more = rest >> bits
        on = more > 0
        level += 1
        if not on.any():
            break
        raw = _padded(np.packbits(on, bitorder="little").tobytes())
        ones = np.bitwise_count(np.frombuffer(raw, "<u8"))
        before = np.zeros(len(ones) + 1, np.int64)
        np.cumsum(ones, out=before[1:])
        parts += [raw, _padded(before[: len(ones) : SAMPLE // 64].astype("<u4").tobytes())]
        rest = more[on]
    return b"DAC1" + bytes([bits, level, 0, 0]) + len(ids).to_bytes(4, "little") + b"\0" * 4 + b"".join(parts)


class Code:
    """A packed sequence: its length, any token, any slice and all of it. Reads the bytes where they lie."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1":
            raise ValueError("not a code")
        self.bits, levels = raw[4], raw[5]
        self.size = int.from_bytes(raw[8:12], "little")
        at, self.levels = 16, []
        for level in range(levels):
            n = int.from_bytes(raw[at : at + 4], "little")
            at += 8
            chunks = np.frombuffer(raw, "<u1" if self.bits == 8 else "<u2", n, at)
            at += -(-n * self.bits // 64) * 8
            bitmap = ranks = None
            if level < levels - 1:
                words = -(-n // 64)
                bitmap = np.frombuffer(raw, "<u8", words, at)
                at += 8 * words
                count = -(-words * 64 // SAMPLE)
                ranks = np.frombuffer(raw, "<u4", count, at)
                at += -(-count // 2) * 8
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not -self.size <= i < self.size:
            raise IndexError(i)
        i %= self.size
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += self.bits
            if bitmap is None:
                break
            word, bit = divmod(i, 64)
            w = int(bitmap[word])
            if not w >> bit & 1:
                break
            first = word // (SAMPLE // 64) * (SAMPLE // 64)
            i = int(ranks[i // SAMPLE]) + int(np.bitwise_count(bitmap[first:word]).sum()) + (w & ((1 << bit) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        at = np.arange(self.size)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.int64) << (level * self.bits)
            if bitmap is not None:
                at = at[np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(chunks)] > 0]
        return out


class Vocabulary:
    """Byte-level BPE of a file of ranks; the driver reads the file, a worker gets the ranks and makes its own encoder of them."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    def __getstate__(self):
        return self.ranks

    def __setstate__(self, ranks):
        self.ranks = ranks

    @cached_property
    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})


def encoding(path: str = VOCABULARY):
    return Vocabulary(path).encoding


def tokenize(docs: DataFrame, path: str = VOCABULARY, bits: int = BITS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``n_tokens`` and the ``code`` of the text's token ids, and the names of those columns."""
    schema, names = extended(docs, {"n_tokens": T.LongType(), "code": T.BinaryType()})
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoding.encode_ordinary
        for batch in batches:
            text = A.as_text(batch.column(at))
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in A.row_runs(text):
                ids = [encode(t) for t in text.slice(lo, hi - lo).to_pylist()]
                mask = null[lo:hi]
                size = pa.array(np.array([len(i) for i in ids], np.int64), mask=mask)
                code = pa.array([None if no else pack(np.array(i, np.int64), bits) for i, no in zip(ids, mask)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, size, code], names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names


def token_at(df: DataFrame, code: str = "code", position: str = "position") -> tuple[DataFrame, str]:
    """``df`` with the token at each row's position (from 0; null where there is none), and the name of that column."""
    schema, names = extended(df, {"token": T.LongType()})
    c, p = df.columns.index(code), df.columns.index(position)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for raw, i in zip(batch.column(c), batch.column(p).to_pylist()):
                of = Code(raw.as_py()) if raw.is_valid and i is not None else None
                got.append(of[i] if of is not None and 0 <= i < len(of) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names=schema.fieldNames())

    return df.mapInArrow(run, schema), names["token"]
