"""Exact top-k by dot product of unit vectors: one query or many through the same scorer and ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to all executors at once; more queries are searched block by block.
QUERY_BYTES = 16_000_000
#: Vectors and queries of one matrix product, and rows a task holds before it keeps only the best.
RUN = 1_000
HELD_ROWS = 500_000
#: Ranked rows of which a join with the store may be a broadcast.
RANKED_ROWS = 1_000_000
DIGITS = 12


def where(store: DataFrame, equal: dict | None) -> DataFrame:
    """Rows whose metadata equal all the given values; a key the rows lack equals None only. Struct keys reach the scan,
    and a domain its partitions too."""
    if not equal:
        return store
    meta = store.schema["meta"].dataType.names if "meta" in store.columns else []
    at = lambda k: F.col(f"meta.`{k}`") if k in meta else F.col("extra")[k] if "extra" in store.columns and k not in store.columns else F.col(k)
    tests = [at(k).eqNullSafe(F.lit(v)) for k, v in equal.items()]
    if "part_domain" in store.columns and "domain" in equal:
        tests.append(F.col("part_domain").eqNullSafe(F.lit(equal["domain"])))
    return store.where(reduce(Column.__and__, tests))


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The k best of each query of rows (q, key, score): highest score first, then smallest key."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("key", "ascending")]))
    q = rows.column("q").to_numpy()
    edge = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(edge, np.diff(np.append(edge, len(q))))
    return rows.filter(pa.array(rank < k))


def _task(shared, k: int):
    """Rows (q, key, score): a task's k best of each query, handed over once at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        held, n = [], 0
        least = np.full(len(matrix), -np.inf)  # the k-th score of each query so far: lower ones need not be held
        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                batch = batch.filter(lists.is_valid())
                lists = batch.column(1)
            if not len(lists) or not len(matrix):
                continue
            if set(pc.list_value_length(lists).to_pylist()) - {matrix.shape[1]}:
                raise ValueError("vectors of different sizes")
            vectors = lists.flatten().to_numpy().reshape(len(lists), matrix.shape[1])
            for lo in range(0, len(vectors), RUN):
                part = vectors[lo : lo + RUN]
                for first in range(0, len(matrix), RUN):
                    score = np.round(matrix[first : first + RUN] @ part.T, DIGITS)
                    floor = least[first : first + RUN]
                    if k < score.shape[1]:
                        floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
                        least[first : first + RUN] = floor
                    q, at = np.nonzero(score >= floor[:, None])
                    held.append(pa.table({"q": first + q, "key": batch.column(0).take(pa.array(lo + at)), "score": score[q, at]}))
                    n += len(q)
                if n > HELD_ROWS:
                    held = [_best(pa.concat_tables(held), k)]
                    n = len(held[0])
        if held:
            yield from _best(pa.concat_tables(held), k).to_batches()

    return run


def top_k(store: DataFrame, queries: DataFrame, k: int = 5, equal: dict | None = None, key: str = "chunk_id", vector: str = "vector", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, score, rank): ties by key. Only key and vector of the store are read.

    ``queries`` has query_id and query_vector. They go to every task as a matrix of at most ``query_bytes``; more of them
    are searched in blocks, each in a scan of its own. A task hands on its k best of each query, so what is shuffled
    is tasks x queries x k rows. Scores are rounded to DIGITS, so that equal vectors tie whatever the order of summation.
    """
    side = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    size = side.agg(F.count("*").alias("n"), F.max(F.size("query_vector")).alias("d")).first()
    blocks = max(1, -(-size["n"] * max(size["d"] or 1, 1) * 8 // query_bytes))
    rows = where(store, equal).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = store.schema[key].dataType.simpleString()
    out = None
    for block in range(blocks):
        held = (side.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else side).toArrow().combine_chunks()
        ids, lists = held.column("query_id"), held.column("query_vector").combine_chunks()
        sizes = set(pc.list_value_length(lists).to_pylist())
        if len(sizes) > 1:
            raise ValueError("vectors of different sizes")
        matrix = lists.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        found = rows.mapInArrow(_task(store.sparkSession.sparkContext.broadcast(matrix), k), f"q bigint, key {kind}, score double")
        best = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
        names = store.sparkSession.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids}))
        best = best.join(F.broadcast(names), "q").select("query_id", F.col("key").alias(key), "score", "rank")
        out = best if out is None else out.unionByName(best)
    out.most_rows = size["n"] * k
    return out


def nearest(store: DataFrame, query: list[float], k: int = 5, equal: dict | None = None, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(key, score, rank) for one vector, by the same scorer."""
    one = store.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_vector array<double>")
    return top_k(store, one, k, equal, key, vector).drop("query_id")
