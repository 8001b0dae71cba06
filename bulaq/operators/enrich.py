"""Metadata of chunks: position, number of chunks, title, date, the document's own keys, and the text to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def embedding_text(text: Column, *parts: Column) -> Column:
    """``[domain | title | heading | date]`` and the text on the next line; empty parts are left out."""
    header = F.concat_ws(" | ", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])
    return F.when(header != "", F.concat(F.lit("["), header, F.lit("]\n"), text)).otherwise(text)


def enrich(chunks: DataFrame, header: bool = True, default_year: int | None = None) -> DataFrame:
    """Chunks that carry the document columns ``title``, ``date``, ``extra`` and ``doc_text``, where there are such.

    What a chunk has already wins, but for doc_id, position and n_chunks, which come from the chunker.
    """
    has = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    date = F.coalesce(F.nullif(has("date"), F.lit("")), X.extract_date(F.left(has("doc_text"), F.lit(500)), default_year))
    out = chunks.withColumn("_n", F.col("n_chunks").cast("int")).withColumn("_date", date).withColumn("_title", F.nullif(has("title"), F.lit("")))
    extra = F.coalesce(F.col("extra"), empty) if "extra" in chunks.columns else empty
    own = F.coalesce(F.col("mark_extra"), empty)
    merged = F.map_concat(F.map_filter(extra, lambda k, _: ~F.map_contains_key(own, k)), own)
    meta = F.struct(F.col("meta.*"), F.col("doc_id"), F.col("position").cast("int").alias("position"), F.col("_n").alias("n_chunks"), F.col("_title").alias("title"), F.col("_date").alias("date"))
    out = out.withColumn("extra", merged).withColumn("meta", meta)
    text = embedding_text(F.col("text"), F.col("meta.domain"), F.col("meta.title"), F.col("meta.section_heading"), F.col("meta.date")) if header else F.col("text")
    return out.select("chunk_id", "doc_id", "text", "start", "end", "meta", "extra", text.alias("embedding_text"))
