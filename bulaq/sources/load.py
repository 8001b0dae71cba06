"""Corpora and questions from JSON, JSON Lines, text, and whatever reader is registered, as DataFrames of one schema."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry

formats = Registry("corpus format")
DOCUMENT_FIELDS = {"doc_id": ["doc_id", "id"], "text": ["text", "content", "body"], "domain": ["domain"], "title": ["title"], "date": ["date", "published_at"]}
QUERY_FIELDS = {"query": ["query", "question"], "relevant_ids": ["relevant_ids", "source_doc_ids"], "domain": ["domain"], "query_id": ["query_id", "id"]}


def register_format(suffix: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    formats.register(suffix if suffix.startswith(".") else f".{suffix}", reader)


register_format(".jsonl", lambda spark, path: spark.read.json(path))
register_format(".json", lambda spark, path: spark.read.option("multiLine", True).json(path))
register_format(".parquet", lambda spark, path: spark.read.parquet(path))


def keys(fields: dict[str, list[str]], field_map: dict | None) -> dict[str, list[str]]:
    """Names of each field in the order of trial: those of the caller before the built-in ones."""
    out = {k: list(v) for k, v in fields.items()}
    for name, own in (field_map or {}).items():
        if name not in out:
            raise KeyError(f"unknown field {name!r}. Options: {sorted(out)}")
        own = [own] if isinstance(own, str) else list(own)
        out[name] = own + [k for k in out[name] if k not in own]
    return out


def first_given(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of the columns that is neither null nor empty."""
    have = [n for n in names if n in df.columns]
    if kind != "string":
        return F.coalesce(*[F.col(f"`{n}`").cast(kind) for n in have], F.lit(None).cast(kind))
    return F.coalesce(*[F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in have], F.lit(None).cast("string"))


def extras(df: DataFrame, known: set[str]) -> Column:
    """Map of all scalar columns that are no field, and over them the record's own ``metadata``."""
    scalars = [f.name for f in df.schema if f.name not in known and f.name != "metadata" and f.dataType.typeName() not in ("struct", "array", "map", "binary", "void")]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").cast("string").alias("v")) for n in scalars]) if scalars else F.lit(None).cast("array<struct<k:string,v:string>>")
    own = F.map_from_entries(F.filter(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")), lambda p: p["v"].isNotNull()))
    if "metadata" not in df.columns or df.schema["metadata"].dataType.typeName() not in ("struct", "map"):
        return own
    kind = df.schema["metadata"].dataType
    if kind.typeName() == "map":
        given = F.col("metadata").cast("map<string,string>")
    else:
        of = lambda f: F.col(f"metadata.`{f.name}`").cast("string") if f.dataType.typeName() not in ("struct", "array", "map") else F.to_json(F.col(f"metadata.`{f.name}`"))
        given = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f.name).alias("k"), of(f).alias("v")) for f in kind]), lambda p: p["v"].isNotNull()))
    given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(given, k)), given)


def documents_of(records: DataFrame, default_domain: str = "general", field_map: dict | None = None) -> DataFrame:
    """(doc_id, text, domain, title, date, extra) of records; one without an id is an error. Ids become text, 0 too."""
    names = keys(DOCUMENT_FIELDS, field_map)
    known = {n for v in names.values() for n in v}
    of = lambda f: first_given(records, names[f])
    doc_id = F.coalesce(of("doc_id"), F.raise_error(F.lit("a record has no doc_id; name its column in field_map")).cast("string"))
    return records.select(doc_id.alias("doc_id"), F.coalesce(of("text"), F.lit("")).alias("text"), F.coalesce(of("domain"), F.lit(default_domain)).alias("domain"), of("title").alias("title"), of("date").alias("date"), extras(records, known).alias("extra"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the file system of the path, which may be a remote one, has a folder there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _has_texts(spark: SparkSession, path: str) -> bool:
    """Whether a folder has a .txt file at any depth; the listing ends at the first one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().lower().endswith(".txt"):
            return True
    return False


def _texts(spark: SparkSession, path: str, domain: str, folder: bool) -> DataFrame:
    r = spark.read
    r = r.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]") if folder else r
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    null = F.lit(None).cast("string")
    return r.text(path, wholetext=True).select(F.regexp_replace(name, r"(?i)\.txt$", "").alias("doc_id"), F.col("value").alias("text"), F.lit(domain).alias("domain"), null.alias("title"), null.alias("date"), F.create_map().cast("map<string,string>").alias("extra"))


def records(spark: SparkSession, path: str) -> DataFrame:
    suffix = os.path.splitext(path)[1]
    if suffix not in formats:
        raise ValueError(f"no reader for {suffix!r}; available: {formats.names()}, or add one by register_format")
    return formats.get(suffix)(spark, path)


def load_documents(spark: SparkSession, path: str, default_domain: str = "general", field_map: dict | None = None) -> DataFrame:
    """Documents of a folder of texts, one text, or a file of records."""
    folder = _is_folder(spark, path)
    if path.lower().endswith(".txt") or folder and _has_texts(spark, path):
        return _texts(spark, path, default_domain, folder)
    return documents_of(records(spark, path), default_domain, field_map)


def first(documents: DataFrame, n: int) -> DataFrame:
    """The ``n`` documents with the smallest ids; each task keeps no more than ``n`` rows."""
    return documents.orderBy("doc_id").limit(n)


def from_texts(spark: SparkSession, texts: list[str], domain: str = "general", ids: list[str] | None = None) -> DataFrame:
    """Documents of plain strings; ids are doc00000 and on where none are given."""
    ids = ids if ids is not None else [f"doc{i:05d}" for i in range(len(texts))]
    if len(ids) != len(texts):
        raise ValueError("as many ids as texts are needed")
    rows = [(i, t, domain, None, None, {}) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id string, text string, domain string, title string, date string, extra map<string,string>")


def queries_of(found: DataFrame, documents: DataFrame | None = None, field_map: dict | None = None) -> DataFrame:
    """(query_id, query, relevant_ids, domain) of questions that are answerable and have text and gold ids.

    With documents, gold ids they lack are dropped, questions without any left too, and a missing domain is that of
    the gold document with the smallest id.
    """
    names = keys(QUERY_FIELDS, field_map)
    have = [n for n in names["relevant_ids"] if n in found.columns]
    as_ids = lambda n: F.col(n).cast("array<string>") if found.schema[n].dataType.typeName() == "array" else F.when(F.col(n).isNotNull(), F.array(F.col(n).cast("string")))
    given = [F.filter(as_ids(n), lambda x: x.isNotNull() & (x != "")) for n in have]
    ids = F.array_distinct(F.coalesce(*[F.when(F.size(g) > 0, g) for g in given], F.lit(None).cast("array<string>")))
    answerable = F.coalesce(F.col("answerable").cast("boolean"), F.lit(True)) if "answerable" in found.columns else F.lit(True)
    of = lambda f: first_given(found, names[f])
    query = of("query")
    q = found.where(answerable).select(F.coalesce(of("query_id"), F.md5(query.cast("binary"))).alias("query_id"), query.alias("query"), ids.alias("relevant_ids"), of("domain").alias("domain"))
    q = q.where(F.col("query").isNotNull() & (F.size("relevant_ids") > 0))
    if documents is None:
        return q
    pairs = q.select("query_id", F.explode("relevant_ids").alias("doc_id")).join(documents.select("doc_id", F.col("domain").alias("d")), "doc_id")
    gold = pairs.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant_ids"), F.min_by("d", "doc_id").alias("d"))
    return q.drop("relevant_ids").join(gold, "query_id").select("query_id", "query", "relevant_ids", F.coalesce("domain", "d").alias("domain"))


def load_queries(spark: SparkSession, path: str, documents: DataFrame | None = None, field_map: dict | None = None) -> DataFrame:
    return queries_of(records(spark, path), documents, field_map)


__all__ = ["documents_of", "first", "formats", "from_texts", "load_documents", "load_queries", "queries_of", "register_format"]
