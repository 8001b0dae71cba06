"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Counts are 64-bit keys of ``ORDER`` characters of 12 bits each, so that the context and the shorter n-gram are bit
operations and all of the estimation is grouping and joining sharded count tables in the JVM. Characters beyond
U+0BFF fall into 1,024 classes, such that those of one alphabet differ (of Han and Hangul, about 20 and 11 share one).
A text's perplexity comes from the probabilities of its n-grams: a model of at most ``BROADCAST_ENTRIES`` entries is
sent to the executors; a larger one is joined, as sharded tables, to the distinct n-grams of blocks of documents
(``perplexity(..., broadcast_entries=0)`` always takes that way). Both give the same score to the last bit.

A text's score is its mean negative log-probability per character, drawn towards its language's mean with the
weight of ``PRIOR`` characters, for a short text says little. It is rejected when the score is above its language's
limit. One in ``HELD_OUT`` trusted texts, by a hash of the text, is kept out of the model and sets the limits: the
language's quantile ``QUANTILE`` of scores, moved away from its median to ``SLACK`` times the distance, since the
quantile itself would reject its share of all good text (``slack=1`` takes it as it is); the distance is at least that
of all languages' deviations from their medians together. A language without such texts has the highest of the limits.

Defined results: null and empty texts have a null score and are rejected; a null language is a language of its own;
repeated rows count and are scored one by one; with no trusted text every text that has a character is kept; an
empty table gives an empty result; other columns are carried along, and a result column whose name is taken gets
underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import column_of, discard, extended, id_side, kept, scope, spare, staged

ORDER = 5
BITS = 12
BROADCAST_ENTRIES = 4_000_000
BROADCAST_LANGUAGES = 100_000
PRIOR = 60
QUANTILE = 0.99
SLACK = 2.0
HELD_OUT = 4
BLOCK_CHARS = 16_000_000
START = 1


def symbols(codes: np.ndarray) -> np.ndarray:
    """Characters as numbers below 4096: white space is one symbol, all digits another."""
    kind = A.kinds()[codes]
    out = np.where(codes < 3072, codes, 3072 + (codes & np.uint32(1023))).astype(A.U64)
    out[(kind == A.SPACE) | (kind == A.NEWLINE)] = 32
    out[kind == A.DIGIT] = 48
    return out


def grams(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of the n-gram that ends at each character; a text is preceded by start symbols."""
    s = symbols(codes)
    key = s.copy()
    since = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER):
        prior = np.full(len(s), START, A.U64)
        prior[back:] = s[:-back] if back < len(s) else prior[:0]
        prior[since < back] = START
        key |= prior << A.U64(BITS * back)
    return key


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, codes, offsets in A.sub_batches(batch.column("text")):
            key, n = np.unique(grams(codes, offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "c"])


def _discounts(counts: dict[int, DataFrame]) -> dict[int, list[float]]:
    """The three discounts of each order, from its numbers of n-grams that were counted once to four times."""
    each = [t.where("c <= 4").groupBy(F.lit(n).alias("n"), "c").count() for n, t in counts.items()]
    every = each[0]
    for t in each[1:]:
        every = every.union(t)
    seen = {(r["n"], r["c"]): r["count"] for r in every.collect()}
    out = {}
    for n in counts:
        n1, n2, n3, n4 = (seen.get((n, i), 0) for i in (1, 2, 3, 4))
        if not n1 or not n2:
            out[n] = [0.5, 0.75, 1.0]
            continue
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
        out[n] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]
    return out


class Model:
    """``probability[n]`` (key, lp) and ``backoff[n]`` (key of the context, lg, ...): logarithms of order n; staged tables."""

    def __init__(self, probability: dict[int, DataFrame], backoff: dict[int, DataFrame], unseen: float, entries: int):
        self.probability, self.backoff, self.unseen, self.entries = probability, backoff, unseen, entries
        self._shared = None

    def tables(self) -> list[DataFrame]:
        return [*self.probability.values(), *self.backoff.values()]

    def shared(self):
        """The model in memory, broadcast once."""
        if self._shared is None:
            self._shared = self.probability[1].sparkSession.sparkContext.broadcast(Lookup(self))
        return self._shared


def train(trusted: DataFrame) -> Model:
    """Model of the column ``text`` of all rows."""
    text = trusted.select(column_of(trusted, "text", "string")).where("text is not null")
    counts = {ORDER: staged(text.mapInArrow(_count, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")))}
    for n in range(ORDER - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1))
        counts[n] = staged(counts[n + 1].groupBy(low.alias("key")).agg(F.count("*").alias("c")))
    vocabulary = counts[1].count() + 1
    unseen = float(np.log(1 / vocabulary))
    discounts = _discounts(counts)
    prob: dict[int, DataFrame] = {}
    back: dict[int, DataFrame] = {}
    lower = None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = discounts[n]
        c = counts[n].withColumn("ctx", F.shiftright("key", BITS) if n > 1 else F.lit(0).cast("bigint"))
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = c.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(off).alias("mass")).withColumn("gamma", F.col("mass") / F.col("total"))
        ctx = staged(ctx.select(F.col("ctx").alias("key"), "total", "gamma", F.log("gamma").alias("lg")))
        p = c.join(ctx.select(F.col("key").alias("ctx"), "total", "gamma"), "ctx").withColumn("own", (F.col("c") - off) / F.col("total"))
        if lower is None:
            p = p.select("key", F.log(F.col("own") + F.col("gamma") / vocabulary).alias("lp"))
        else:
            p = p.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(lower.select(F.col("key").alias("low"), F.col("lp").alias("llp")), "low")
            p = p.select("key", F.log(F.col("own") + F.col("gamma") * F.exp("llp")).alias("lp"))
        prob[n] = lower = staged(p)
        back[n] = ctx
    if vocabulary > 1:  # an unseen character has the uniform share of the unigram's discounts
        unseen += back[1].first()["lg"]
    for t in counts.values():
        discard(t)
    sizes = None
    for t in (*prob.values(), *back.values()):
        sizes = t.select("key") if sizes is None else sizes.union(t.select("key"))
    entries = sizes.count()
    return Model(prob, back, unseen, entries)


class Lookup:
    """A model in memory: log-probabilities of whole arrays of n-grams."""

    def __init__(self, model: Model):
        def load(df: DataFrame, value: str):
            got = df.select("key", value).toArrow()
            return A.HashIndex(got.column(0).to_numpy().view(A.U64)), got.column(1).to_numpy()

        self.p = {n: load(model.probability[n], "lp") for n in range(1, ORDER + 1)}
        self.b = {n: load(model.backoff[n], "lg") for n in range(2, ORDER + 1)}
        self.unseen = model.unseen

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), self.unseen)
        rest = np.arange(len(key))
        missed = []
        for n in range(ORDER, 0, -1):
            k = key[rest] & A.U64((1 << BITS * n) - 1)
            index, lp = self.p[n]
            at = index.find(k)
            hit = at >= 0
            out[rest[hit]] = lp[at[hit]]
            rest, k = rest[~hit], k[~hit]
            if n > 1 and len(rest):
                index, lg = self.b[n]
                at = index.find(k >> A.U64(BITS))
                ok = at >= 0
                missed.append((rest[ok], lg[at[ok]]))
        for rows, lg in reversed(missed):  # lower orders first, as the joins add them
            out[rows] = lg + out[rows]
        return out


def _sums(codes: np.ndarray, offsets: np.ndarray, lookup) -> np.ndarray:
    """Negative log-probability of each text; the sum of a text does not depend on those beside it."""
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        key, where = np.unique(grams(codes, offsets), return_inverse=True)
        out[some] = -np.add.reduceat(lookup(key)[where], offsets[:-1][some])
    return out


def _broadcast(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    schema, names = extended(docs, {"nll": T.DoubleType(), "chars": T.LongType()})
    at = docs.columns.index("text")
    shared = model.shared()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nll, chars = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi, codes, offsets in A.sub_batches(batch.column(at)):
                nll[lo:hi], chars[lo:hi] = _sums(codes, offsets, shared.value), np.diff(offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nll), pa.array(chars)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema), names["nll"], names["chars"]


def _joined(docs: DataFrame, model: Model, block_chars: int) -> tuple[DataFrame, str, str]:
    schema, names = extended(docs, {"nll": T.DoubleType(), "chars": T.LongType()})
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // block_chars + 1
    _, own = extended(docs, {"block": T.LongType()})
    block = own["block"]
    laid = docs.withColumn(block, F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(blocks))).repartition(block)
    at, mine = laid.columns.index("text"), laid.columns.index(block)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(mine).to_numpy()
            for b in np.unique(of):
                rows = batch.filter(pa.array(of == b))
                for _, _, codes, offsets in A.sub_batches(rows.column(at)):
                    key = np.unique(grams(codes, offsets)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b)), pa.array(key)], names=["block", "key"])

    asked = laid.mapInArrow(distinct, "block bigint, key bigint").distinct()
    value = F.lit(model.unseen)
    for n in range(1, ORDER + 1):
        asked = asked.withColumn("k", F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1)))
        asked = asked.join(model.probability[n].select(F.col("key").alias("k"), F.col("lp").alias(f"p{n}")), "k", "left")
        if n > 1:
            asked = asked.withColumn("k", F.shiftright("k", BITS)).join(model.backoff[n].select(F.col("key").alias("k"), F.col("lg").alias(f"b{n}")), "k", "left")
            value = F.coalesce(F.col(f"p{n}"), F.coalesce(F.col(f"b{n}"), F.lit(0.0)) + value)
        else:
            value = F.coalesce(F.col("p1"), value)
    asked = asked.select("block", "key", value.alias("lp"))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        k = right.column("key").to_numpy().view(A.U64)
        order = np.argsort(k)
        lp = right.column("lp").to_numpy()[order]
        k = k[order]
        nll, chars = np.zeros(left.num_rows), np.zeros(left.num_rows, np.int64)
        for lo, hi, codes, offsets in A.sub_batches(left.column(at)):
            nll[lo:hi], chars[lo:hi] = _sums(codes, offsets, lambda q: lp[np.searchsorted(k, q)]), np.diff(offsets)
        left = left.drop_columns([block])
        return pa.table([*left.columns, pa.array(nll), pa.array(chars)], names=schema.fieldNames())

    out = laid.groupBy(block).cogroup(asked.groupBy("block")).applyInArrow(score, schema)
    return out, names["nll"], names["chars"]


def perplexity(docs: DataFrame, model: Model, broadcast_entries: int = BROADCAST_ENTRIES, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str, str]:
    """``docs`` with each text's negative log-probability and length, and the names of those columns."""
    if model.entries <= broadcast_entries:
        return _broadcast(docs, model)
    return _joined(docs, model, block_chars)


def classify(docs: DataFrame, trusted: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, quantile: float = QUANTILE, slack: float = SLACK) -> tuple[DataFrame, str, str]:
    """``docs`` with the score, a boolean whether it is kept, and the names of these columns.

    ``trusted`` has rows of the same kind (text, lang); the limits come from quantiles of their scores.
    """
    with scope():
        return _classify(docs, trusted, broadcast_entries, quantile, slack)


def _classify(docs: DataFrame, trusted: DataFrame, broadcast_entries: int, quantile: float, slack: float) -> tuple[DataFrame, str, str]:
    trusted = trusted.select(column_of(trusted, "text", "string"), column_of(trusted, "lang", "string"))
    fold = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT))
    model = train(trusted.where(fold != 0))
    if model.entries > broadcast_entries:  # the joins of the result read the tables
        for t in model.tables():
            kept(t)
    seen, nll, chars = perplexity(trusted.where(fold == 0), model, broadcast_entries)
    seen = staged(seen.where(F.col(chars) > 0).select(F.coalesce("lang", F.lit("")).alias("lang"), F.col(nll).alias("nll"), F.col(chars).alias("chars")))
    each = seen.groupBy("lang").agg((F.sum("nll") / F.sum("chars")).alias("mean"))
    every = seen.agg(F.sum("nll") / F.sum("chars")).first()[0] or 0.0
    value = lambda mean, nll, chars: F.round((nll + PRIOR * mean) / (chars + PRIOR), 9)

    own = staged(seen.join(each, "lang").select("lang", "mean", value(F.col("mean"), F.col("nll"), F.col("chars")).alias("s")))
    at = lambda q: F.percentile_approx("s", q, 10000)
    middle = own.groupBy("lang").agg(F.first("mean").alias("mean"), at(0.5).alias("m"), at(quantile).alias("q"))
    away = own.join(middle.drop("mean"), "lang").select((F.col("s") - F.col("m")).alias("s")).agg(at(quantile).alias("q")).first()["q"]
    top = F.col("m") + slack * F.greatest(F.col("q") - F.col("m"), F.lit(away))
    limits = kept(staged(middle.select("lang", "mean", top.alias("top"))))
    known = limits.agg(F.count("*").alias("n"), F.max("top").alias("top")).first()

    out, nll, chars = perplexity(docs, model, broadcast_entries)
    lang, mean, top = (spare(n, out) for n in ("limit_lang", "limit_mean", "limit_top"))
    side = limits.select(F.col("lang").alias(lang), F.col("mean").alias(mean), F.col("top").alias(top))
    side = F.broadcast(side) if known["n"] <= BROADCAST_LANGUAGES else side
    own = F.coalesce(out["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    out = out.join(side, own == side[lang], "left")
    schema, names = extended(out, {"lm_score": T.DoubleType(), "kept": T.BooleanType()})
    score = value(F.coalesce(F.col(mean), F.lit(every)), F.col(nll), F.col(chars))
    out = out.withColumn(names["lm_score"], F.when(F.col(chars) > 0, score))
    most = F.coalesce(F.col(top), F.lit(float("inf") if known["top"] is None else known["top"]))
    out = out.withColumn(names["kept"], F.coalesce(F.col(names["lm_score"]) <= most, F.lit(False)))
    return out.drop(nll, chars, lang, mean, top), names["lm_score"], names["kept"]


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are labelled as of good quality; every such row, text and language."""
    good = labels.select(column_of(labels, "doc_id", "bigint").alias("good"), column_of(labels, "quality", "int").alias("q"))
    good = good.where("q = 1").select("good").distinct()
    text = docs.select(column_of(docs, "doc_id", "bigint"), column_of(docs, "text", "string"), column_of(docs, "lang", "string"))
    return text.join(id_side(good), F.col("doc_id") == F.col("good"), "left_semi")


def keep(docs: DataFrame, labels: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """``docs`` without the rejected rows; columns as they were."""
    out, score, good = classify(docs, trusted_rows(docs, labels), broadcast_entries)
    return out.where(F.col(good)).drop(score, good)
