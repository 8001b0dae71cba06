"""Embedders: Column of texts to Column of unit vectors. The default one is deterministic and needs no model."""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import Registry

embedders = Registry("embedder")


class Embedder:
    """``documents`` and ``query`` may differ, by prefixes or task types; both give vectors of length one."""

    name = "embedder"
    dim: int | None = None

    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]:
        raise NotImplementedError

    def _column(self, c: Column, query: bool, batch_size: int | None = None) -> Column:
        me = self

        @F.arrow_udf("array<double>")
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                if not len(part):
                    yield pa.array([], pa.list_(pa.float64()))
                for lo, hi in _runs(part):
                    texts = pc.fill_null(part.slice(lo, hi - lo), "").to_pylist()
                    size = batch_size or len(texts)
                    for i in range(0, len(texts), size):
                        yield _lists(me.vectors(texts[i : i + size], query))

        return run(c)

    def documents(self, c: Column, batch_size: int | None = None) -> Column:
        """Vectors of texts; so many are handed to the model at once (if not given, as many as have RUN_BYTES together)."""
        return self._column(c, False, batch_size)

    def query(self, c: Column) -> Column:
        return self._column(c, True)


def _lists(vectors: list) -> pa.Array:
    sizes = np.array([len(v) for v in vectors], np.int64)
    flat = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))


def unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


#: Bytes of text that are made Python strings at once, unless one text has more.
RUN_BYTES = 4_000_000


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have RUN_BYTES together at most, or one row that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_BYTES, side="right")))
        yield lo, hi
        lo = hi


class Grams:
    """Counts of hashed character n-grams by text, as arrays. ``place`` gives the bucket of a gram (UTF-8) times two, plus its sign bit.

    Texts are handled in runs of at most RUN_CHARS positions, so memory follows that and the longest single text. A gram is
    packed into a word by dense numbers of the characters seen; places are kept in a table of SLOTS words, one gram a slot:
    only grams that are not there are hashed, each once a run.
    """

    RUN_CHARS, RUN_TEXTS, SLOTS, LETTERS = 500_000, 1_000, 1 << 21, 1 << 12

    def __init__(self, sizes: tuple[int, ...], dim: int, place: Callable[[bytes], int]):
        if max(sizes) > 5:
            raise ValueError("n-grams of five characters at most")
        self.sizes, self.dim, self.place = sizes, dim, place
        self._keys = None

    def __getstate__(self):
        return {"sizes": self.sizes, "dim": self.dim, "place": self.place, "_keys": None}

    def _clear(self) -> None:
        self._keys, self._places = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64)
        self._letter, self._letters = np.zeros(0x110000, np.uint16), 0

    def _numbered(self, codes: np.ndarray) -> np.ndarray | None:
        """Dense numbers of the characters; None if there are more than LETTERS different ones."""
        new = np.unique(codes[self._letter[codes] == 0])
        if self._letters + len(new) >= self.LETTERS:
            self._clear()
            new = np.unique(codes)
            if len(new) >= self.LETTERS:
                return None
        self._letter[new] = np.arange(self._letters + 1, self._letters + 1 + len(new))
        self._letters += len(new)
        return self._letter[codes]

    def _add(self, counts: np.ndarray, codes: np.ndarray, text: np.ndarray, left: np.ndarray, lo: int, hi: int) -> None:
        """Counts the grams that start at lo .. hi - 1; ``left`` has the characters from a position to the end of its text."""
        letters = self._numbered(codes[lo : hi + max(self.sizes) - 1])
        if letters is None:
            mid = (lo + hi) // 2
            self._add(counts, codes, text, left, lo, mid)
            self._add(counts, codes, text, left, mid, hi)
            return
        letters = np.append(letters, np.zeros(max(self.sizes), np.uint16)).astype(np.uint64)
        for n in self.sizes:
            at = np.flatnonzero(left[lo:hi] >= n)
            key = np.full(hi - lo, n, np.uint64) << np.uint64(60)
            for i in range(n):
                key |= letters[i : i + hi - lo] << np.uint64(12 * i)
            key = key[at]
            slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (self.SLOTS - 1)
            place = self._places[slot]
            miss = np.flatnonzero(self._keys[slot] != key)
            if len(miss):
                new, first, which = np.unique(key[miss], return_index=True, return_inverse=True)
                got = np.array([self.place(codes[i : i + n].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")) for i in (lo + at[miss[first]]).tolist()], np.int64)
                place[miss] = got[which]
                to, one = np.unique(slot[miss[first]], return_index=True)
                self._keys[to], self._places[to] = new[one], got[one]
            counts += np.bincount(text[lo + at] * (2 * self.dim) + place, minlength=len(counts))

    def counts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Arrays (texts, dim, sign bit) of the counts, run by run, which cover the texts in order."""
        if self._keys is None:
            self._clear()
        lo = 0
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo])
            while hi < len(texts) and hi - lo < self.RUN_TEXTS and chars + len(texts[hi]) <= self.RUN_CHARS:
                chars += len(texts[hi])
                hi += 1
            codes = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
            size = np.array([len(t) for t in texts[lo:hi]], np.int64)
            text = np.repeat(np.arange(hi - lo), size)
            left = np.repeat(np.cumsum(size), size) - np.arange(chars)
            out = np.zeros((hi - lo) * self.dim * 2, np.int64)
            for a in range(0, chars, self.RUN_CHARS):
                self._add(out, codes, text, left, a, min(a + self.RUN_CHARS, chars))
            yield out.reshape(hi - lo, self.dim, 2)
            lo = hi


def blake_place(gram: bytes, dim: int) -> int:
    d = hashlib.blake2b(gram, digest_size=8).digest()
    return int.from_bytes(d[:4], "little") % dim * 2 + (d[4] & 1)


class Hashed(Embedder):
    """Signed counts of hashed 3-, 4- and 5-grams of the lower-cased text between spaces, damped by log(1 + n)."""

    def __init__(self, dim: int = 256):
        self.dim, self.name, self._grams = dim, f"hashed-{dim}", Grams((3, 4, 5), dim, partial(blake_place, dim=dim))

    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out: list[list[float]] = []
        for c in self._grams.counts([f" {X.az_lower(t)} " for t in texts]):
            total = (c[:, :, 1] - c[:, :, 0]).astype(np.float64)
            v = np.sign(total) * np.log1p(np.abs(total))
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            out += list(v / np.where(norm > 0, norm, 1.0))
        return out


def md5_place(gram: bytes, dim: int) -> int:
    number = int(hashlib.md5(gram).hexdigest()[:7], 16)
    return (number >> 1) % dim * 2 + (number & 1)


def hashed_md5(df: DataFrame, key: str, text: str, dim: int = 256, n: int = 3) -> DataFrame:
    """(key, bucket, value): the same idea for ``n``-grams by md5; not normalised. Rows of one key count together.

    Grams are counted in Arrow batches, and a gram that comes again is not hashed again.
    """
    grams = Grams((n,), dim, partial(md5_place, dim=dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _runs(batch.column(1)):
                part, at = batch.slice(lo, hi - lo), 0
                for c in grams.counts(part.column(1).to_pylist()):
                    row, bucket = np.nonzero(c.any(2))
                    s = c[row, bucket, 0] - c[row, bucket, 1]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at + row)), pa.array(bucket), pa.array(s)], names=["key", "bucket", "s"])
                    at += len(c)

    texts = df.select(F.col(key).alias("key"), F.concat(F.lit(" "), X.lower(F.col(text)), F.lit(" ")).alias("text")).where("text is not null")
    signed = texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, bucket bigint, s bigint")
    out = signed.groupBy(F.col("key").alias(key), "bucket").agg(F.sum("s").alias("s"))
    return out.select(key, "bucket", (F.signum(F.col("s").cast("double")) * F.log1p(F.abs("s").cast("double"))).alias("value"))


class ApiError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Rest(Embedder):
    """A remote model: batches, retries on 429, 5xx and network errors, and halving of a batch that is refused (400, 413)."""

    url, key_name = "", ""

    def __init__(self, model: str, dim: int, batch: int = 16, tries: int = 4, wait: float = 2.0, timeout: float = 120.0, api_key: str | None = None):
        self.name, self.model, self.dim, self.batch, self.tries, self.wait, self.timeout = model, model, dim, batch, tries, wait, timeout
        self.key = api_key or os.environ.get(self.key_name)
        if not self.key:
            raise ValueError(f"set {self.key_name} or give api_key")

    def body(self, texts: list[str], query: bool) -> dict:
        return {"model": self.model, "input": texts, "dimensions": self.dim, "encoding_format": "float"}

    def parse(self, got: dict) -> list[list[float]]:
        return [d["embedding"] for d in sorted(got["data"], key=lambda d: d["index"])]

    def send(self, payload: dict) -> dict:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(payload).encode(), headers), timeout=self.timeout) as r:
            return json.load(r)

    def _post(self, payload: dict) -> dict:
        for again in range(self.tries):
            try:
                return self.send(payload)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise ApiError(str(e), e.code) from e
                error, status = e, e.code
            except OSError as e:
                error, status = e, None
            if again < self.tries - 1:
                time.sleep(self.wait * 2**again)
        raise ApiError(f"no answer after {self.tries} tries: {error}", status)

    def _part(self, texts: list[str], query: bool) -> list[list[float]]:
        try:
            return self.parse(self._post(self.body(texts, query)))
        except ApiError as e:
            if e.status not in (400, 413) or len(texts) == 1:
                raise
            mid = len(texts) // 2
            return self._part(texts[:mid], query) + self._part(texts[mid:], query)

    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]:
        texts = [(t.strip() or " ")[:16_000] for t in texts]
        return [unit(v) for i in range(0, len(texts), self.batch) for v in self._part(texts[i : i + self.batch], query)]


class OpenAI(Rest):
    url, key_name = "https://api.openai.com/v1/embeddings", "OPENAI_API_KEY"

    def __init__(self, model: str = "text-embedding-3-small", dim: int = 1536, batch: int = 64, **o):
        super().__init__(model, dim, batch, **o)


class Qwen(Rest):
    url, key_name = "https://dashscope-intl.aliyuncs.com/compatible-mode/v1/embeddings", "DASHSCOPE_API_KEY"

    def __init__(self, model: str = "text-embedding-v4", dim: int = 1024, **o):
        super().__init__(model, dim, **{"batch": 10, **o})


class HuggingFace(Rest):
    key_name = "HF_TOKEN"

    def __init__(self, model: str = "BAAI/bge-m3", dim: int = 1024, **o):
        super().__init__(model, dim, **o)
        self.url = f"https://router.huggingface.co/hf-inference/models/{model}/pipeline/feature-extraction"

    def body(self, texts, query):
        return {"inputs": texts}

    def parse(self, got):
        return got


class Gemini(Rest):
    key_name = "GEMINI_API_KEY"

    def __init__(self, model: str = "gemini-embedding-2", dim: int = 768, batch: int = 32, **o):
        super().__init__(model, dim, batch, **o)
        self.url = f"https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents?key={self.key}"

    def body(self, texts, query):
        task = "RETRIEVAL_QUERY" if query else "RETRIEVAL_DOCUMENT"
        return {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, "taskType": task, "outputDimensionality": self.dim} for t in texts]}

    def parse(self, got):
        return [e["values"] for e in got["embeddings"]]


class Local(Embedder):
    """A model of the sentence-transformers library, if that is installed; loaded once in each worker."""

    def __init__(self, model: str, prefix: str = "", dim: int = 1024, batch: int = 32):
        self.name, self.model, self.prefix, self.dim, self.batch, self._loaded = model, model, prefix, dim, batch, None

    def vectors(self, texts: list[str], query: bool = False) -> list[list[float]]:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        texts = [self.prefix + t for t in texts] if query else texts
        return [list(map(float, v)) for v in self._loaded.encode(texts, batch_size=self.batch, normalize_embeddings=True)]


embedders.register("hashed", Hashed)
embedders.register("openai", OpenAI)
embedders.register("qwen3", Qwen)
embedders.register("hf-api", HuggingFace)
embedders.register("gemini", Gemini)
embedders.register("bge-m3", lambda **o: Local("BAAI/bge-m3", **o))
embedders.register("arctic", lambda **o: Local("Snowflake/snowflake-arctic-embed-l-v2.0", "query: ", **o))
__all__ = ["ApiError", "Embedder", "Hashed", "Rest", "embedders", "hashed_md5", "unit"]
