"""Command line: index, search, eval, chunk."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import Normalizer
from .operators import evaluate
from .operators.chunking import two_pass
from .operators.embed import embedders
from .operators.store import stores
from .plans.engine import Engine
from .sources import load

VERSION = "0.1.0"


def _engine(spark: SparkSession, a) -> Engine:
    """The engine of the arguments; an index that is loaded from a file is held by the session and leaves the store alone."""
    if getattr(a, "load", None):
        engine = Engine(spark, None, a.embedder, backend="memory")
        engine.load(a.load)
        return engine
    options = {"chroma": {"collection_name": a.collection, "persist_directory": a.persist_dir}, "pinecone": {"index_name": a.index_name}}.get(a.backend, {})
    if a.dimension:
        options["dimension"] = a.dimension
    return Engine(spark, a.store, a.embedder, backend=a.backend, namespace=a.namespace, backend_options=options)


def _empty(engine: Engine) -> bool:
    if engine.count():
        return False
    print("the index is empty: run index first", file=sys.stderr)
    return True


def _index(spark, a) -> int:
    docs = load.load_documents(spark, a.path, a.domain)
    n = docs.count()
    if not n:
        print("no documents found", file=sys.stderr)
        return 1
    engine = _engine(spark, a)
    print(f"{n} documents, {engine.add_documents(docs, progress=a.progress)} new chunks, {engine.count()} chunks in all (embedder {engine.embedder.name})")
    if a.save:
        (engine.save_json if a.save.endswith(".json") else engine.save)(a.save)
        print(f"saved to {a.save}")
    return 0


def _search(spark, a) -> int:
    engine = _engine(spark, a)
    if _empty(engine):
        return 1
    rows = [r.asDict(recursive=True) for r in engine.search(a.query, a.k, {"domain": a.filter_domain} if a.filter_domain else None).collect()]
    if a.json:
        print(json.dumps(rows, ensure_ascii=False, indent=2))
        return 0
    for r in rows:
        heading = r["metadata"].get("section_heading")
        text = r["text"] if len(r["text"]) <= 400 else r["text"][:400] + "…"
        print(f"\n#{r['rank']}  score={r['score']:.4f}  [{r['metadata'].get('domain', '?')}] {r['doc_id']}{f' — {heading}' if heading else ''}\n   {text}")
    return 0


def _eval(spark, a) -> int:
    engine = _engine(spark, a)
    if _empty(engine):
        return 1
    rep = engine.evaluate(load.load_queries(spark, a.queries), a.k, a.latencies)
    print(evaluate.markdown(rep))
    if a.out:
        with open(a.out, "w", encoding="utf-8") as out:
            json.dump(rep, out, ensure_ascii=False, indent=2)
        print(f"\nwritten to {a.out}")
    return 0


def _chunk(spark, a) -> int:
    docs = load.load_documents(spark, a.path, a.domain).withColumn("text", Normalizer()(F.col("text")))
    for r in two_pass(a.chunk_size)(docs).orderBy("doc_id", "position").toLocalIterator():
        print(f"--- {r['chunk_id']}  [{r['meta']['chunking']}] {r['meta']['section_heading'] or '-'}  ({len(r['text'])} chars)\n{r['text'][:300]}{'…' if len(r['text']) > 300 else ''}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="bulaq")
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--store", default="bulaq-store")
    common.add_argument("--embedder", default="hashed", choices=embedders.names())
    common.add_argument("--backend", default="parquet", choices=stores.names())
    common.add_argument("--namespace", default="default")
    common.add_argument("--collection", default="bulaq", help="Chroma collection")
    common.add_argument("--persist-dir", help="folder of a local Chroma")
    common.add_argument("--index-name", default="bulaq", help="Pinecone index")
    common.add_argument("--dimension", type=int, help="numbers of a vector, if not the embedder's")
    c = sub.add_parser("index", parents=[common])
    c.add_argument("path"), c.add_argument("--domain", default="general"), c.add_argument("--save"), c.add_argument("--progress", action="store_true")
    c.set_defaults(run=_index)
    c = sub.add_parser("search", parents=[common])
    c.add_argument("query"), c.add_argument("-k", type=int, default=5), c.add_argument("--filter-domain"), c.add_argument("--load"), c.add_argument("--json", action="store_true")
    c.set_defaults(run=_search)
    c = sub.add_parser("eval", parents=[common])
    c.add_argument("queries"), c.add_argument("-k", type=int, default=5), c.add_argument("--load"), c.add_argument("--out"), c.add_argument("--latencies", type=int, default=20, help="queries that are also searched alone, for the median time")
    c.set_defaults(run=_eval)
    c = sub.add_parser("chunk")
    c.add_argument("path"), c.add_argument("--domain", default="general"), c.add_argument("--chunk-size", type=int, default=800)
    c.set_defaults(run=_chunk)
    a = p.parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("bulaq").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
