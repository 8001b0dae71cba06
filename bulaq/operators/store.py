"""Chunk stores. The default one is a Parquet folder of parts and versions; remote ones are in operators.remote."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import Registry

stores = Registry("store")
SCHEMA = (
    "chunk_id string, doc_id string, text string, start int, end int, meta struct<domain:string,chunking:string,section_heading:string,marker_type:string,article_number:bigint,"
    "clause_number:string,heading_level:int,doc_id:string,position:int,n_chunks:int,title:string,date:string>, extra map<string,string>, embedding_text string, vector array<double>"
)


def last_of_each(new: DataFrame, key: str = "chunk_id", seq: str | None = None) -> DataFrame:
    """One row per key: the one with the largest ``seq``, or any where no order is given."""
    if seq is None:
        return new.dropDuplicates([key])
    rest = [c for c in new.columns if c != key]
    best = new.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return best.select(key, "_r.*").select(*new.columns)


def missing(new: DataFrame, old: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks; only the key of ``old`` is read."""
    return new.join(old.select(key), key, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str = "chunk_id", seq: str | None = None) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    new = last_of_each(new, key, seq)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class Store(Protocol):
    """What the engine needs of a store; one that ranks by itself has ``search(queries, k, equal)`` too, one that knows
    its ids better than by a scan ``missing(chunks)``."""

    def scan(self) -> DataFrame: ...

    def chunks(self) -> DataFrame: ...

    def add_new(self, df: DataFrame) -> int: ...

    def upsert(self, df: DataFrame, seq: str | None = None) -> None: ...

    def replace(self, df: DataFrame) -> None: ...

    def existing(self, ids: DataFrame) -> DataFrame: ...

    def count(self) -> int: ...

    def clear(self) -> None: ...


class FrameStore:
    """Chunks of a DataFrame that the session holds: for indexes loaded from a file, and for tests."""

    def __init__(self, spark: SparkSession, path: str | None = None, namespace: str = "default", dimension: int | None = None, embedder: str | None = None):
        self.spark = spark
        self.rows = spark.createDataFrame([], SCHEMA)

    def scan(self) -> DataFrame:
        return self.rows

    def chunks(self) -> DataFrame:
        return self.scan().drop("vector")

    def replace(self, df: DataFrame) -> None:
        self.rows = df.select(*self.rows.columns)

    def add_new(self, df: DataFrame) -> int:
        n = self.count()
        self.rows = self.rows.unionByName(df.select(*self.rows.columns))
        return self.count() - n

    def upsert(self, df: DataFrame, seq: str | None = None) -> None:
        self.rows = merged(self.rows, df.select(*self.rows.columns), seq=seq)

    def existing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.scan().select("chunk_id"), "chunk_id", "left_semi")

    def count(self) -> int:
        return self.scan().count()

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], SCHEMA))


class ParquetStore(FrameStore):
    """Parts ``part=<id>`` under ``path/namespace``, split by domain, and numbered versions that list the parts they have.

    A version is written aside and renamed to the next free number once its parts are whole, so a reader sees one
    version or the other; a writer that finds the number taken begins again from the newer version, so nothing of two
    writers is lost. Beyond ``COMPACT`` parts a write makes one of them; parts that the last ``KEPT`` versions do not
    name are deleted.
    """

    COMPACT, KEPT, TRIES = 32, 3, 20

    def __init__(self, spark: SparkSession, path: str, namespace: str = "default", dimension: int | None = None, embedder: str | None = None):
        self.spark, self.path, self.dimension, self.embedder = spark, f"{path.rstrip('/')}/{namespace}", dimension, embedder
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._at()
        return sorted(x.getPath().getName()[len(prefix) :] for x in fs.listStatus(p) if x.getPath().getName().startswith(prefix)) if fs.exists(p) else []

    def _version(self, number: int) -> list[str]:
        text = self.spark.read.text(f"{self.path}/version={number:012d}", wholetext=True).first()
        return [x for x in (text[0] if text else "").split(",") if x]

    def current(self) -> tuple[int, list[str]]:
        """(number of the newest version, its parts); 0 before the first."""
        numbers = self._names("version=")
        return (int(numbers[-1]), self._version(int(numbers[-1]))) if numbers else (0, [])

    def _publish(self, number: int, parts: list[str]) -> bool:
        """Whether version ``number`` was still free."""
        fs, aside = self._at(f"new-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(",".join(parts).encode()))
        out.close()
        jvm = self.spark._jvm
        _, to = self._at(f"version={number:012d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(aside, to, self.spark._sc._gateway.new_array(rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            if "AlreadyExists" in str(e) or fs.exists(to):
                return False
            raise
        return True

    def _change(self, parts_of: Callable[[list[str]], list[str]]) -> None:
        """Publishes what ``parts_of`` makes of the newest version's parts, again if another writer came first."""
        for _ in range(self.TRIES):
            number, parts = self.current()
            if self._publish(number + 1, parts_of(parts)):
                self._forget()
                return
        raise RuntimeError("the store changes too often")

    def _forget(self) -> None:
        """Deletes older versions and the parts that only they name."""
        numbers = [int(n) for n in self._names("version=")]
        old, kept = numbers[: -self.KEPT], numbers[-self.KEPT :]
        if not old:
            return
        named = {p for n in kept for p in self._version(n)}
        gone = {p for n in old for p in self._version(n)} - named
        for name in [f"version={n:012d}" for n in old] + [f"part={p}" for p in gone]:
            fs, p = self._at(name)
            fs.delete(p, True)

    def _read(self, parts: list[str]) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("part_domain", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], full)
        read = lambda p: self.spark.read.schema(full).option("basePath", f"{self.path}/part={p}").parquet(f"{self.path}/part={p}")
        return reduce(DataFrame.union, map(read, parts))

    def scan(self) -> DataFrame:
        """All rows, with ``part_domain``, by which a filter on the domain skips files."""
        return self._read(self.current()[1])

    def chunks(self) -> DataFrame:
        return self.scan().drop("vector", "part_domain")

    def _write(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        if self.dimension:
            ok = F.assert_true(F.size("vector") == self.dimension, f"vectors of this store have {self.dimension} numbers")
            df = df.withColumn("vector", F.when(ok.isNull(), F.col("vector")))
        df.select(*self.schema.names, F.col("meta.domain").alias("part_domain")).write.partitionBy("part_domain").parquet(f"{self.path}/part={name}")
        return name

    def _compacted(self, parts: list[str]) -> list[str]:
        return [self._write(self._read(parts))] if len(parts) > self.COMPACT else parts

    def add_new(self, df: DataFrame) -> int:
        """Append rows that are known to be missing; returns their number."""
        part = self._write(df)
        self._change(lambda parts: self._compacted([*parts, part]))
        return self._read([part]).count()

    def upsert(self, df: DataFrame, seq: str | None = None) -> None:
        """Writes the new rows as a part of their own, and of the old parts again only those that have one of their ids."""
        part = self._write(last_of_each(df, seq=seq))
        ids = self._read([part]).select("chunk_id")

        def parts_of(parts: list[str]) -> list[str]:
            named = [self._read([p]).select("chunk_id", F.lit(p).alias("part")) for p in parts]
            touched: set[str] = set()
            if named:
                touched = {r["part"] for r in reduce(DataFrame.union, named).join(ids, "chunk_id", "left_semi").select("part").distinct().collect()}
            rest = [p for p in parts if p not in touched]
            if touched:
                rest.append(self._write(self._read(sorted(touched)).join(ids, "chunk_id", "left_anti")))
            return self._compacted([*rest, part])

        self._change(parts_of)

    def replace(self, df: DataFrame) -> None:
        part = self._write(df)
        self._change(lambda _: [part])

    def clear(self) -> None:
        self._change(lambda _: [])


_TRANSIENT = "connection,timeout,timed out,getaddrinfo,temporarily,unavailable,reset by peer,broken pipe,too many requests,502,503,504,eof occurred".split(",")


def transient(e: Exception) -> bool:
    return any(m in f"{type(e).__name__} {e}".lower() for m in _TRANSIENT)


def retried(call: Callable, tries: int = 5, wait: float = 2.0, sleep: Callable = time.sleep):
    """Result of ``call``; transient errors are tried again with doubled waits, others raised at once."""
    for again in range(tries):
        try:
            return call()
        except Exception as e:
            if not transient(e):
                raise
            error = e
        if again < tries - 1:
            sleep(wait * 2**again)
    raise ConnectionError(f"gave up after {tries} tries ({error}); re-running resumes") from error


def scalar_metadata(meta: dict) -> dict:
    """What remote stores take: no nulls, other than scalars as text."""
    return {k: v if isinstance(v, (str, int, float, bool)) else str(v) for k, v in meta.items() if v is not None}


stores.register("memory", FrameStore)
stores.register("parquet", ParquetStore)
