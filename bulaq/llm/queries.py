"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, kneser, quality_rules, sanitize, simhash, spiece, template, toxicity, warc
from .tables import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, score = toxicity.flagged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col(score).alias("toxicity"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = spiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return out.select("doc_id", F.col(n["ids"]).alias("ids"), F.col(n["n_tokens"]).alias("n_tokens"), F.col(n["lossless"]).alias("lossless"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, score = quality_rules.keep(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col(score).alias("quality"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", *[F.col(n[c]).alias(c) for c in ("host", "title", "slots", "text")])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    out, score, kept = kneser.classify(docs, kneser.trusted_rows(docs, labels))
    return out.where(F.col(kept)).select("doc_id", "lang", F.col(score).alias("score"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = sanitize.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col(n["n_entities"]).alias("n_entities"), F.col(n["n_terms"]).alias("n_terms"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = dac.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(n["n_tokens"]).alias("n_tokens"), F.col(n["code"]).alias("code"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_toxicity, op3_simhash, op4_sentencepiece, op5_quality_rules,
        op6_html, op7_quality_classifier, op8_pii, op9_warc, op10_token_codes,
    )
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.matches_sql(),
    "op9_warc": warc.SQL,
}
