"""Feature rows of documents and the bounded labelled sample on which the classifiers are fitted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import column_of, extended

#: Labelled rows on which a classifier is fitted at most; the bound is all that keeps the driver's work constant.
SAMPLE_ROWS = 20_000

Features = Callable[[np.ndarray, np.ndarray], np.ndarray]


def labelled_text(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, taken in the order of a hash of the id.

    Labels without id or target are ignored, as are those of which there is no document with text; of several
    labels of one id the largest target counts.
    """
    known = labels.select(column_of(labels, "doc_id", "bigint"), column_of(labels, target, "int")).dropna()
    chosen = known.groupBy("doc_id").agg(F.max(target).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(column_of(docs, "doc_id", "bigint"), column_of(docs, "text", "string")).where("text is not null")
    return text.join(F.broadcast(chosen), "doc_id")


def sample(
    docs: DataFrame, labels: DataFrame, target: str, features: Features, rows: int = SAMPLE_ROWS, where: Column | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, 0/1 target, id) of labelled_text(), or of its rows that fulfil ``where``; always in the same order."""
    both = labelled_text(docs, labels, target, rows)
    both = both if where is None else both.where(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, offsets in A.sub_batches(batch.column("text")):
                x = features(codes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(x.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "y", "x"],
                )

    got = both.mapInArrow(run, "doc_id bigint, y int, x array<double>").toArrow()
    width = features(np.zeros(0, np.uint32), np.zeros(1, np.int64)).shape[1]
    ids, y = got.column("doc_id").to_numpy(), got.column("y").to_numpy().astype(float)
    x = np.concatenate([c.flatten().to_numpy() for c in got.column("x").chunks] or [np.zeros(0)]).reshape(len(ids), width)
    order = np.lexsort((*x.T, ids))
    return x[order], y[order], ids[order]


def scored(docs: DataFrame, features: Features, score: Callable[[np.ndarray], np.ndarray], name: str) -> tuple[DataFrame, str]:
    """``docs`` with a double column of scores, null where the text is null, and the column's name."""
    schema, names = extended(docs, {name: T.DoubleType()})
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.zeros(batch.num_rows)
            for lo, hi, codes, offsets in A.sub_batches(batch.column(at)):
                value[lo:hi] = score(features(codes, offsets))
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=null)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names[name]


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
