"""The corpus pipeline: quality classifier, near-dedup, decontamination, sanitisation, token ids.

Defined results: a null or empty text is rejected by the first stage, so later stages see none; a row with a null
``doc_id`` is kept where its text is (it is in no group of near duplicates); repeated rows are one document to the
near-dedup stage, which keeps or drops all rows of an id; without labels every text that has a character passes the
first stage; without benchmark items nothing is contaminated; an empty table gives an empty result; columns that
documents have besides the usual ones are carried through all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulaq.llm import decontaminate, kneser, sanitize, simhash, spiece
from bulaq.llm.tables import discard, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language-model score is within their language's limit; the trusted text is that labelled good."""
    return kneser.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that are in none."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, protected entities and disclosing terms generalised or removed; n_chars follows the text."""
    out, names = sanitize.sanitize(docs)
    out = out.drop(*names.values())
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces."""
    return spiece.encode(docs)[0]


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", tokens),
]

#: No stage but decontamination can be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows are written into the shared folder, read by the next and then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
