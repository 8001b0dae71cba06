"""Stores on a server: one interface for their clients, and batches, retries and searches on top of it.

A client is made in every task that needs one. It has

* ``dimension()`` (None if the collection does not exist) and ``create(dimension)``,
* ``upsert(rows)`` of dicts (id, values, metadata with text),
* ``query(vector, k, equal)``: rows (id, score, metadata), best first,
* ``ids()``: pages of ids, ``fetch(ids)``: {id: (values, metadata)},
* ``count()`` and ``clear()``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .store import SCHEMA, retried, scalar_metadata, stores

FETCH = 100


class RemoteStore:
    """Chunks of one collection; all its rows go through the executors, never through the driver."""

    def __init__(self, spark: SparkSession, connect: Callable, dimension: int | None = None, batch: int = 100, tries: int = 5, wait: float = 2.0):
        self.spark, self.connect, self.dimension, self.batch, self.tries, self.wait = spark, connect, dimension, batch, tries, wait
        has = self._call(lambda c: c.dimension())
        if has is None:
            if dimension is None:
                raise ValueError("the collection does not exist; give the dimension to create it")
            self._call(lambda c: c.create(dimension))
        elif dimension is not None and int(has) != int(dimension):
            raise ValueError(f"the collection has vectors of {int(has)} numbers, the embedder gives {int(dimension)}: use another collection or dim={int(has)}")

    def _call(self, f: Callable):
        client = self.connect()
        return retried(lambda: f(client), self.tries, self.wait)

    def _sent(self) -> Callable:
        connect, size, tries, wait = self.connect, self.batch, self.tries, self.wait

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client, n = connect(), 0
            for batch in batches:
                rows = batch.to_pylist()
                for i in range(0, len(rows), size):
                    part = []
                    for d in rows[i : i + size]:
                        meta = {**dict(d["extra"] or ()), **(d["meta"] or {}), "embedding_text": d["embedding_text"], "text": d["text"], "doc_id": d["doc_id"], "start": d["start"], "end": d["end"]}
                        part.append({"id": d["chunk_id"], "values": d["vector"], "metadata": scalar_metadata(meta)})
                    retried(lambda part=part: client.upsert(part), tries, wait)
                    n += len(part)
            yield pa.RecordBatch.from_pydict({"n": [n]})

        return run

    def add_new(self, df: DataFrame) -> int:
        """Upserts rows in batches; an attempt that is run again writes the same ids again. Returns their number."""
        names = self.spark.createDataFrame([], SCHEMA).columns
        return df.select(*names).mapInArrow(self._sent(), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def upsert(self, df: DataFrame, seq: str | None = None) -> None:
        self.add_new(store.last_of_each(df, seq=seq))

    def replace(self, df: DataFrame) -> None:
        self.clear()
        self.add_new(df)

    def existing(self, ids: DataFrame) -> DataFrame:
        """The ids that the collection has; each task asks for its own."""
        connect, tries, wait = self.connect, self.tries, self.wait

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = connect()
            for batch in batches:
                asked = batch.column(0).to_pylist()
                for i in range(0, len(asked), FETCH):
                    part = asked[i : i + FETCH]
                    got = retried(lambda part=part: client.fetch(part), tries, wait)
                    yield pa.RecordBatch.from_arrays([pa.array([x for x in part if x in got], pa.string())], names=["chunk_id"])

        return ids.select("chunk_id").mapInArrow(run, "chunk_id string")

    def missing(self, new: DataFrame) -> DataFrame:
        return new.join(self.existing(new.select("chunk_id").distinct()), "chunk_id", "left_anti")

    def scan(self) -> DataFrame:
        """All chunks: ids are listed page by page by one task, rows are fetched by many."""
        connect, tries, wait = self.connect, self.tries, self.wait
        schema = self.spark.createDataFrame([], SCHEMA).schema
        known = [(f.name, f.dataType.simpleString()) for f in schema["meta"].dataType]

        def listed(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _batch in _:
                client = connect()
                for page in retried(lambda: list(client.ids()), tries, wait):
                    yield pa.RecordBatch.from_arrays([pa.array(page, pa.string())], names=["chunk_id"])

        def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = connect()
            for batch in batches:
                asked = batch.column(0).to_pylist()
                for i in range(0, len(asked), FETCH):
                    part = asked[i : i + FETCH]
                    got = retried(lambda part=part: client.fetch(part), tries, wait)
                    rows = [(x, [float(v) for v in got[x][0]], [(k, str(v)) for k, v in got[x][1].items()]) for x in part if x in got]
                    if rows:
                        kinds = (pa.string(), pa.list_(pa.float64()), pa.map_(pa.string(), pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chunk_id", "vector", "m"])

        ids = self.spark.range(1).mapInArrow(listed, "chunk_id string")
        rows = ids.repartition("chunk_id").mapInArrow(fetched, "chunk_id string, vector array<double>, m map<string,string>")
        m = F.col("m")
        number = lambda c, kind: c.cast("double").cast(kind)  # noqa: E731  (servers give whole numbers as floats)
        meta = F.struct(*[(number(m[n], k) if k in ("int", "bigint") else m[n]).alias(n) for n, k in known])
        own = F.array(*map(F.lit, [n for n, _ in known] + ["text", "start", "end", "embedding_text"]))
        extra = F.map_filter(m, lambda k, _: ~F.array_contains(own, k))
        doc = F.coalesce(m["doc_id"], F.split_part("chunk_id", F.lit("::"), F.lit(1)))
        start = lambda n: F.coalesce(number(m[n], "int"), F.lit(0))
        return rows.select("chunk_id", doc.alias("doc_id"), F.coalesce(m["text"], F.lit("")).alias("text"), start("start").alias("start"), start("end").alias("end"), meta.alias("meta"), extra.alias("extra"), m["embedding_text"].alias("embedding_text"), "vector")

    def chunks(self) -> DataFrame:
        return self.scan().drop("vector")

    def search(self, queries: DataFrame, k: int, equal: dict | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, doc_id, score, text, metadata): the server ranks, each task asks for its queries."""
        connect, tries, wait = self.connect, self.tries, self.wait

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = connect()
            for batch in batches:
                rows = []
                for q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for rank, (x, score, meta) in enumerate(retried(lambda v=v: client.query(v, k, equal), tries, wait), 1):
                        meta = dict(meta)
                        text = str(meta.pop("text", ""))
                        doc = str(meta.get("doc_id") or x.split("::")[0])
                        meta.pop("embedding_text", None)
                        rows.append((q, rank, x, doc, float(score), text, [(n, str(w)) for n, w in meta.items()]))
                kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()))
                names = ["query_id", "rank", "chunk_id", "doc_id", "score", "text", "metadata"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", F.col("query_vector").cast("array<double>")).mapInArrow(run, f"query_id {kind}, rank int, chunk_id string, doc_id string, score double, text string, metadata map<string,string>")

    def count(self) -> int:
        return self._call(lambda c: c.count())

    def clear(self) -> None:
        self._call(lambda c: c.clear())


def _get(of, name: str, default=None):
    got = of.get(name) if isinstance(of, dict) else getattr(of, name, None)
    return default if got is None else got


class Pinecone:
    """Client of one namespace of a Pinecone index."""

    def __init__(self, index: str = "bulaq", namespace: str = "", api_key: str | None = None, metric: str = "cosine", cloud: str = "aws", region: str = "us-east-1"):
        import pinecone

        key = api_key or os.environ.get("PINECONE_API_KEY")
        if not key:
            raise ValueError("set PINECONE_API_KEY or give api_key")
        self.lib, self.api, self.index, self.namespace, self.metric, self.place = pinecone, pinecone.Pinecone(api_key=key), index, namespace, metric, (cloud, region)

    @property
    def at(self):
        return self.api.Index(self.index)

    def dimension(self) -> int | None:
        return next((_get(i, "dimension") for i in self.api.list_indexes() if _get(i, "name") == self.index), None)

    def create(self, dimension: int) -> None:
        cloud, region = self.place
        self.api.create_index(name=self.index, dimension=dimension, metric=self.metric, spec=self.lib.ServerlessSpec(cloud=cloud, region=region))

    def upsert(self, rows: list[dict]) -> None:
        self.at.upsert(vectors=rows, namespace=self.namespace)

    def query(self, vector, k: int, equal: dict | None):
        only = {n: {"$eq": v} for n, v in equal.items()} if equal else None
        got = self.at.query(vector=list(vector), top_k=k, namespace=self.namespace, filter=only, include_metadata=True)
        return [(_get(m, "id"), _get(m, "score", 0.0), _get(m, "metadata", {})) for m in _get(got, "matches", [])]

    def ids(self):
        for page in self.at.list(namespace=self.namespace):
            yield [x if isinstance(x, str) else _get(x, "id") for x in page]

    def fetch(self, ids: list[str]) -> dict:
        got = _get(self.at.fetch(ids=ids, namespace=self.namespace), "vectors", {})
        return {i: (_get(r, "values", []), _get(r, "metadata", {})) for i, r in got.items()}

    def count(self) -> int:
        spaces = _get(self.at.describe_index_stats(), "namespaces", {})
        return int(_get(_get(spaces, self.namespace, {}), "vector_count", 0))

    def clear(self) -> None:
        self.at.delete(delete_all=True, namespace=self.namespace)


class Chroma:
    """Client of one Chroma collection; the text is kept as the document."""

    def __init__(self, collection: str = "bulaq", path: str | None = None):
        import chromadb

        client = chromadb.PersistentClient(path=path) if path else chromadb.Client()
        self.at = client.get_or_create_collection(name=collection, metadata={"hnsw:space": "cosine"})

    def dimension(self) -> int | None:
        got = self.at.get(limit=1, include=["embeddings"])["embeddings"]
        return len(got[0]) if got is not None and len(got) else None

    def create(self, dimension: int) -> None:
        """A collection takes the size of its first vector."""

    def upsert(self, rows: list[dict]) -> None:
        meta = [{k: v for k, v in r["metadata"].items() if k != "text"} for r in rows]
        self.at.upsert(ids=[r["id"] for r in rows], embeddings=[list(r["values"]) for r in rows], documents=[r["metadata"].get("text", "") for r in rows], metadatas=meta)

    def query(self, vector, k: int, equal: dict | None):
        only = None if not equal else equal if len(equal) == 1 else {"$and": [{n: v} for n, v in equal.items()]}
        got = self.at.query(query_embeddings=[list(vector)], n_results=max(1, min(k, self.count())), where=only, include=["documents", "metadatas", "distances"])
        return [(i, 1.0 - d, {**(m or {}), "text": t}) for i, t, m, d in zip(*(got[n][0] for n in ("ids", "documents", "metadatas", "distances")))]

    def ids(self):
        size, at = 1000, 0
        while page := self.at.get(limit=size, offset=at, include=[])["ids"]:
            yield list(page)
            at += size

    def fetch(self, ids: list[str]) -> dict:
        got = self.at.get(ids=ids, include=["embeddings", "documents", "metadatas"])
        return {i: (v, {**(m or {}), "text": t}) for i, v, t, m in zip(got["ids"], got["embeddings"], got["documents"], got["metadatas"])}

    def count(self) -> int:
        return self.at.count()

    def clear(self) -> None:
        for page in list(self.ids()):
            self.at.delete(ids=page)


def _pinecone(spark, path=None, namespace="", dimension=None, embedder=None, index_name="bulaq", **options) -> RemoteStore:
    return RemoteStore(spark, lambda: Pinecone(index_name, "" if namespace == "default" else namespace, **options), dimension)


def _chroma(spark, path=None, namespace="", dimension=None, embedder=None, collection_name="bulaq", persist_directory=None) -> RemoteStore:
    return RemoteStore(spark, lambda: Chroma(collection_name, persist_directory), dimension)


stores.register("pinecone", _pinecone)
stores.register("chroma", _chroma)
