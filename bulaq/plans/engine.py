"""The engine: configuration of the stages only; all data are DataFrames and the store."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Normalizer
from ..operators import enrich, evaluate, remote, search, store
from ..operators.chunking import chunkers
from ..operators.embed import Embedder, embedders
from ..sources import export as X
from ..sources import load
from .progress import ProgressBar

assert remote  # its stores are registered by the import
#: Ids that are sent to every executor at most, some 50 bytes each.
BROADCAST_IDS = 2_000_000


class Engine:
    """normalize, chunk, enrich, embed, store; search and evaluation share one scorer.

    Each stage is a name of its registry or a value: ``normalizer`` a function of a Column, ``chunker`` one of a
    DataFrame, ``enricher`` one of chunks (with the documents' columns) that keeps the columns of enrich(), ``embedder``
    an Embedder, ``backend`` a store.
    """

    def __init__(
        self, spark: SparkSession, path: str | None = None, embedder: str | Embedder = "hashed", chunker: str | Callable = "two-pass", normalizer: Callable | None = None,
        enricher: Callable[[DataFrame], DataFrame] | None = None, backend: str | object = "parquet", namespace: str = "default", header: bool = True, default_year: int | None = None,
        chunker_options: dict | None = None, embedder_options: dict | None = None, backend_options: dict | None = None,
    ):
        self.spark = spark
        self.embedder = embedders.create(embedder, **(embedder_options or {})) if isinstance(embedder, str) else embedder
        self.chunker = chunkers.create(chunker, **(chunker_options or {})) if isinstance(chunker, str) else chunker
        if not callable(self.chunker):
            raise TypeError("chunker must be a name or a function of a DataFrame")
        self.own_ids = isinstance(chunker, str) and chunker in ("two-pass", "recursive", "structural")
        self.normalizer = normalizer or Normalizer()
        self.enricher = enricher or (lambda chunks: enrich.enrich(chunks, header, default_year))
        options = {"dimension": self.embedder.dim, "embedder": self.embedder.name} | (backend_options or {})
        self.store = store.stores.create(backend, spark, path, namespace, **options) if isinstance(backend, str) else backend

    def chunks(self, documents: DataFrame) -> DataFrame:
        """Enriched chunks of documents; nothing is stored."""
        docs = documents.withColumn("text", self.normalizer(F.col("text"))).withColumn("doc_text", F.left("text", F.lit(500)))
        return self.enricher(self.chunker(docs))

    def add_documents(self, documents: DataFrame, batch_size: int = 64, progress: bool = False, skip_existing: bool = True) -> int:
        """Index documents; returns how many chunks were embedded. Ids that the store has are not embedded again.

        ``batch_size`` chunks go to the embedder at once. Of chunks with one id the last one of its text counts.
        """
        new = self.chunks(documents)
        if skip_existing:
            new = self._missing(new, documents)
        if not self.own_ids or not documents.groupBy("doc_id").count().where("count > 1").isEmpty():
            position = F.struct(F.col("meta.position"), "start", "text")
            new = store.last_of_each(new.withColumn("_seq", position), seq="_seq").drop("_seq")
        new = new.withColumn("vector", self.embedder.documents(F.col("embedding_text"), batch_size))
        with _watched(self.spark, "Indexing", progress):
            if skip_existing:
                return self.store.add_new(new)
            new = new.persist()
            try:
                n = new.count()
                self.store.upsert(new)
            finally:
                new.unpersist()
            return n

    def _missing(self, new: DataFrame, documents: DataFrame) -> DataFrame:
        """The chunks whose ids the store lacks. Ids it has of these documents are counted first: if there are none nothing
        is joined, and if they are few they are sent, so that the texts of the new chunks stay where they are."""
        if hasattr(self.store, "missing"):
            return self.store.missing(new)
        if not self.own_ids:
            return store.missing(new, self.store.scan())
        ids = self.store.scan().select("chunk_id", "doc_id").join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
        n = ids.count()
        if not n:
            return new
        return store.missing(new, F.broadcast(ids) if n <= BROADCAST_IDS else ids)

    def add_texts(self, texts: list[str], domain: str = "general", ids: list[str] | None = None) -> int:
        return self.add_documents(load.from_texts(self.spark, texts, domain, ids))

    def _results(self, top: DataFrame) -> DataFrame:
        """Late materialisation: text and metadata are joined to the ranked rows, which are sent to the store's rows if few."""
        rows = self.store.chunks()
        doc = F.coalesce(F.nullif("meta.doc_id", F.lit("")), F.split_part("chunk_id", F.lit("::"), F.lit(1)))
        typed = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f.name).alias("k"), F.col(f"meta.{f.name}").cast("string").alias("v")) for f in rows.schema["meta"].dataType]), lambda p: p["v"].isNotNull()))
        extra = F.coalesce("extra", F.create_map().cast("map<string,string>"))
        found = rows.select("chunk_id", doc.alias("doc_id"), "text", F.map_concat(typed, F.map_filter(extra, lambda k, _: ~F.map_contains_key(typed, k))).alias("metadata"))
        few = getattr(top, "most_rows", search.RANKED_ROWS + 1) <= search.RANKED_ROWS
        return found.join(F.broadcast(top) if few else top, "chunk_id")

    def search_batch(self, queries: DataFrame, k: int = 5, where: dict | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, doc_id, score, text, metadata) for all rows (query_id, query) at once."""
        q = queries.select("query_id", self.embedder.query(self.normalizer(F.col("query"))).alias("query_vector"))
        if hasattr(self.store, "search"):
            return self.store.search(q, k, where)
        top = search.top_k(self.store.scan(), q, k, where)
        return self._results(top).select("query_id", "rank", "chunk_id", "doc_id", "score", "text", "metadata")

    def search(self, query: str, k: int = 5, where: dict | None = None) -> DataFrame:
        one = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return self.search_batch(one, k, where).drop("query_id").orderBy("rank")

    def evaluate(self, queries: DataFrame, k: int = 5, latencies: int = 0) -> dict:
        """The report of all queries, searched as one batch; so many of them are also searched alone for the median latency."""
        hits = self.search_batch(queries, k)
        scores = evaluate.per_query(evaluate.hit_ids(hits, queries), k)
        took = []
        for r in queries.select("query").limit(latencies).collect() if latencies else []:
            began = time.perf_counter()
            self.search(r["query"], k).collect()
            took.append(1000 * (time.perf_counter() - began))
        return evaluate.report(scores, k, {"embedder": self.embedder.name, "index": type(self.store).__name__}, took)

    def count(self) -> int:
        return self.store.count()

    def export_chunks(self, path: str, format: str | None = None, distributed: bool = False):
        return (X.export_folder if distributed else X.export)(self.store.chunks(), path, format)

    def save(self, path: str) -> None:
        self.store.scan().select(*self.spark.createDataFrame([], store.SCHEMA).columns).write.mode("overwrite").parquet(path)

    def load(self, path: str) -> None:
        """The store has what save() or save_json() wrote, and nothing else."""
        if path.endswith(".json"):
            return self.load_json(path)
        self.store.replace(self.spark.read.schema(self.spark.createDataFrame([], store.SCHEMA).schema).parquet(path))

    def save_json(self, path: str):
        """One JSON object with ``chunks`` and ``vectors``, for small stores and other tools; written row by row."""
        import json

        meta = lambda r: {k: v for k, v in {**(r["extra"] or {}), **(r["meta"] or {}), "embedding_text": r["embedding_text"]}.items() if v is not None}
        with open(path, "w", encoding="utf-8") as out:
            for part, head in (("chunks", '{"chunks": ['), ("vectors", '], "vectors": [')):
                out.write(head)
                for i, row in enumerate(self.store.scan().orderBy("chunk_id").toLocalIterator()):
                    r = row.asDict(recursive=True)
                    value = r["vector"] if part == "vectors" else {"chunk_id": r["chunk_id"], "doc_id": r["doc_id"], "text": r["text"], "metadata": meta(r), "start": r["start"], "end": r["end"]}
                    out.write((", " if i else "") + json.dumps(value, ensure_ascii=False))
            out.write("]}")

    def load_json(self, path: str) -> None:
        known = self.spark.createDataFrame([], store.SCHEMA).schema["meta"].dataType
        schema = "chunks array<struct<chunk_id:string,doc_id:string,text:string,metadata:map<string,string>,start:int,end:int>>, vectors array<array<double>>"
        each = self.spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(F.arrays_zip("chunks", "vectors")).alias("r"))
        given = F.coalesce(F.col("r.chunks.metadata"), F.create_map().cast("map<string,string>"))
        meta = F.struct(*[given[f.name].try_cast(f.dataType).alias(f.name) for f in known])
        own = F.array(*map(F.lit, [*known.names, "embedding_text"]))
        cols = [F.col(f"r.chunks.{c}").alias(c) for c in ("chunk_id", "doc_id", "text", "start", "end")]
        extra = F.map_filter(given, lambda k, _: ~F.array_contains(own, k))
        self.store.replace(each.select(*cols, meta.alias("meta"), extra.alias("extra"), given["embedding_text"].alias("embedding_text"), F.col("r.vectors").alias("vector")))


class _watched:
    """Shows the share of the finished tasks of the jobs that run meanwhile, if ``show``."""

    def __init__(self, spark: SparkSession, label: str, show: bool):
        self.spark, self.label, self.show, self.over = spark, label, show, threading.Event()

    def __enter__(self):
        if self.show:
            self.thread = threading.Thread(target=self._run, daemon=True)
            self.thread.start()

    def _run(self) -> None:
        tracker, bar = self.spark.sparkContext.statusTracker(), ProgressBar(self.label, 1)
        seen: dict[int, tuple[int, int]] = {}
        while not self.over.wait(0.2):
            for i in tracker.getActiveStageIds():
                info = tracker.getStageInfo(i)
                if info:
                    seen[i] = (info.numCompletedTasks, info.numTasks)
            if seen:
                bar.total = sum(n for _, n in seen.values())
                bar.update(sum(d for d, _ in seen.values()), f"{len(seen)} stages")
        bar.update(bar.total)
        bar.finish()

    def __exit__(self, *_):
        if self.show:
            self.over.set()
            self.thread.join()
