"""Tables shared by the operators: reading, staging in the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir


#: Tables of texts, whose rows take long, and the columns that tell their rows apart.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that has fewer splits than the session has cores, hence few bytes, is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _TEXTS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, _TEXTS[name])
    return df


#: Staged tables of the scopes that are open, the innermost last; those of the first list live until the session ends.
_SCOPES: list[list[DataFrame]] = [[]]


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage ends there, any executor may be lost."""
    path = f"{shared_dir(df.sparkSession)}/bulaq/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _SCOPES[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for of in _SCOPES:
        of[:] = [t for t in of if t is not df]
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope():
    """Deletes the tables that were staged within it, but for those that went through kept()."""
    own: list[DataFrame] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.pop()
        for t in own:
            discard(t)


def kept(df: DataFrame) -> DataFrame:
    """A staged table, handed to the surrounding scope: a result may read it after the inner one ends."""
    for i in range(len(_SCOPES) - 1, 0, -1):
        if any(t is df for t in _SCOPES[i]):
            _SCOPES[i][:] = [t for t in _SCOPES[i] if t is not df]
            _SCOPES[i - 1].append(df)
            break
    return df


@atexit.register
def _last() -> None:
    """What lazy results still read is deleted when Python ends, if the session is there."""
    for t in list(_SCOPES[0]):
        if t.sparkSession.sparkContext._jsc is None:
            break
        discard(t)


#: Rows of one id that are sent to every executor at most, about 20 bytes each; more are joined by shuffling.
BROADCAST_IDS = 8_000_000


def id_side(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (one narrow column), staged, and to be broadcast if it was counted to have at most ``most`` rows.

    So a join with a table of texts shuffles the texts only where the ids are too many to send.
    """
    ids = staged(ids)
    return F.broadcast(ids) if ids.count() <= most else ids


def column_of(df: DataFrame, name: str, kind: str):
    """Column ``name`` cast to ``kind``; nulls of that type where the table lacks it."""
    return df[name].cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def extended(df: DataFrame, extra: dict[str, T.DataType]) -> tuple[T.StructType, dict[str, str]]:
    """Schema of ``df`` with columns added at the end, and the names they got: one that is taken gets underscores."""
    names, fields = {}, list(df.schema.fields)
    taken = {f.name.lower() for f in fields}
    for name, kind in extra.items():
        new = name
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        names[name] = new
        fields.append(T.StructField(new, kind, True))
    return T.StructType(fields), names


def spare(name: str, *tables: DataFrame) -> str:
    """``name`` with underscores, until none of the tables has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root), staged, for all nodes of ``edges`` (a, b): the root is the smallest node of the component.

    Alternates large-star and small-star steps, each a group-by on one endpoint, until the edges stay the same;
    every round's edges are written into the shared folder. Edges with a null end are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = staged(e.distinct())
    state = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, large.a == low.u).select(F.col("b").alias("x"), "u", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        new = staged(small.where("a <> b").distinct())
        after = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(now)
        now = new
        if state == (after["n"], after["s"]):
            break
        state = (after["n"], after["s"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return staged(stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
