"""Vector functions as Column expressions on ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; an error where the sizes differ."""
    same = F.assert_true(F.size(a) == F.size(b), "vectors of different sizes")
    product = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(same.isNull(), product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.when(norm(v) > 0, F.transform(doubles(v), lambda x: x / norm(v))).otherwise(doubles(v))


def token_estimate(text: Column) -> Column:
    """Aggregate: a quarter of all characters."""
    return F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).cast("bigint")


def recall(retrieved: Column, relevant: Column, k: int) -> Column:
    """Distinct relevant ids among the first ``k``, of all relevant ones; 0 without any."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / n).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    ranks = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def ndcg(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary gains; the ideal has as many as there are relevant ids, ``k`` at most."""
    gain = lambda i: 1.0 / F.log2(i + 2.0)
    got = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), gain(i)).otherwise(0.0))
    n = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    best = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + gain(i))
    return F.when(n > 0, F.aggregate(got, F.lit(0.0), lambda s, x: s + x) / best).otherwise(F.lit(0.0))


def upper_median(df: DataFrame, group: str, value: str, name: str = "p50") -> DataFrame:
    """(group, name): the element at position n // 2 of each group's sorted values, from counts of equal values.

    Values are counted before anything is shuffled by group, and a running count finds the middle; no group is held whole.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(group)))
    middle = F.floor(F.col("_all") / 2)
    return ran.where((F.col("_upto") > middle) & (F.col("_upto") - F.col("_n") <= middle)).select(group, F.col(value).alias(name))
