"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: density of a fixed lexicon and of a lexicon of words and word beginnings mined from labels, density of
lexicon words hidden by digits, signs or masked letters, lexicon words near a second person, second-person density,
capitals, exclamation and other punctuation, and the rate of obfuscated words. Of a bounded labelled sample
(``labelled.SAMPLE_ROWS``) one half gives the mined lexicon, a quarter the trees and a quarter the calibration.

Defined results: a null text has a null score and is not flagged, an empty text has the score of zero features;
rows are scored one by one, so repeated rows get equal scores; without labels all texts have the score 0.5 and none
is flagged; an empty table gives an empty result; other columns are carried along, and a result column whose name
is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from . import gbt
from .labelled import SAMPLE_ROWS, labelled_text, per_doc, sample, scored

LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb imbecile cretin loser losers scum trash garbage worthless pathetic disgusting clown clowns "
    "fool fools jerk bastard bitch whore slut asshole shit fuck fucking crap damn retard retarded ugly filthy vermin parasite coward liar hate "
    "idiota idiotas estúpido estúpida imbécil basura inútil payaso asqueroso patético escoria perdedor tonto mierda puta "
    "idiote stupide crétin abruti ordure déchet minable dégoûtant pathétique bouffon connard salaud merde pute "
    "dumm dummkopf trottel abschaum müll wertlos ekelhaft erbärmlich versager arschloch scheiße hure"
).split()
SECOND = "you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen tú ti usted ustedes vosotros vuestro".split()
NEAR = 5
NAMES = ["mined", "mined_weight", "lexicon", "hidden", "any", "near_second", "second", "upper_words", "exclamations", "punctuation", "obfuscated", "words"]
MONOTONE = [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
THRESHOLD = 0.5
#: Lengths of the word beginnings that are mined; a whole word counts too. A beginning is taken if its G statistic and odds reach these.
PREFIXES = (4, 5, 6, 7)
LEAST_G = 25.0
LEAST_ODDS = 6.0
_LEET = dict(zip("013457@$", "oieasta" + "s"))


@cache
def _tables() -> tuple:
    leet = A.folded().copy()
    for c, to in _LEET.items():
        leet[ord(c)] = ord(to)
    plain = np.sort(np.array([A.hash_word(w) for w in dict.fromkeys(LEXICON)], A.U64))
    second = np.sort(np.array([A.hash_word(w) for w in SECOND], A.U64))
    hidden = {w for w in LEXICON if len(w) > 3} | {w[:i] + w[i + 1 :] for w in LEXICON if len(w) > 4 for i in range(1, len(w) - 1)}
    return leet, A.HashIndex(plain), A.HashIndex(second), A.HashIndex(np.sort(np.array([A.hash_word(w) for w in hidden], A.U64)))


def beginnings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word and of its beginnings, one row per word; 0 where the word is no longer than the beginning."""
    size = ends - starts
    out = np.zeros((len(starts), len(PREFIXES) + 1), A.U64)
    if not len(starts):
        return out
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    within = np.arange(total[-1]) - np.repeat(total[:-1], size)
    terms = (low[within + np.repeat(starts, size)].astype(A.U64) + A.U64(1)) * A._powers(int(size.max()))[within]
    run = np.zeros(len(terms) + 1, A.U64)
    np.cumsum(terms, out=run[1:])
    out[:, 0] = A.mix(run[total[1:]] - run[total[:-1]])
    for i, k in enumerate(PREFIXES, 1):
        some = np.flatnonzero(size > k)
        out[some, i] = A.mix(run[total[some] + k] - run[total[some]] + A.U64(k))
    return out


def _mined(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, log odds) of the words and beginnings that set toxic texts of the mining half apart."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, hi, codes, offsets in A.sub_batches(batch.column("text")):
                low = A.folded()[codes]
                starts, ends = A.word_spans(low > 0, offsets)
                doc = np.searchsorted(offsets, starts, side="right") - 1
                h = beginnings(low, starts, ends)
                pair = np.stack([np.repeat(doc.astype(A.U64), h.shape[1]), h.ravel()], 1)
                pair = np.unique(pair[pair[:, 1] > 0], axis=0)
                key, where = np.unique(pair[:, 1], return_inverse=True)
                toxic = np.bincount(where, y[lo + pair[:, 0].astype(np.int64)] > 0, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(toxic), pa.array(np.bincount(where, minlength=len(key)) - toxic)], names=["key", "a", "b"])

    text = labelled_text(docs, labels, "toxic", rows).where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) < 2)
    size = text.agg(F.count(F.when(F.col("y") > 0, 1)).alias("a"), F.count(F.when(F.col("y") <= 0, 1)).alias("b")).first()
    na, nb = size["a"], size["b"]
    if not na or not nb:
        return np.zeros(0, A.U64), np.zeros(0)
    counts = text.mapInArrow(spread, "key bigint, a bigint, b bigint").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (na + nb)
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (share * n))).otherwise(0.0)
    odds = (F.col("a") + 0.5) / (na + 1) / ((F.col("b") + 0.5) / (nb + 1))
    got = counts.where("a >= 3").withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (2 * (part("a", na) + part("b", nb)) >= LEAST_G))
    got = got.select("key", F.log("odds").alias("w")).orderBy("key").toArrow()
    return got.column("key").to_numpy().astype(np.int64).view(A.U64), got.column("w").to_numpy().astype(float)


def features(codes: np.ndarray, offsets: np.ndarray, mined: tuple | None = None) -> np.ndarray:
    """One row of NAMES for each text; densities are logarithms of one plus a rate per thousand words."""
    n = len(offsets) - 1
    if len(codes) == 0:
        return np.zeros((n, len(NAMES)))
    leet, plain, second, masked = _tables()
    low = A.folded()[codes]
    kind = A.kinds()[codes]
    starts, ends = A.word_spans(low > 0, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(doc, minlength=n)
    many = beginnings(low, starts, ends) if mined else None
    h = A.span_hashes(low, starts, ends)
    weight = np.zeros(len(h))
    if mined:
        for i in range(many.shape[1]):
            at = mined[0].find(many[:, i])
            weight = np.maximum(weight, np.where(at >= 0, mined[1][at], 0) if len(mined[1]) else 0)
    bad = plain.find(h) >= 0
    learnt = weight > 0
    fixed, bad = bad, bad | learnt
    you = second.find(h) >= 0
    order = np.arange(len(h))
    before = np.maximum.accumulate(np.where(you, order, -(10**9))) if len(h) else order
    after = np.minimum.accumulate(np.where(you, order, 10**9)[::-1])[::-1] if len(h) else order
    close = bad.copy()
    at = np.flatnonzero(bad)
    b, a = before[at], after[at]
    close[at] = ((at - b <= NEAR) & (doc[np.clip(b, 0, None)] == doc[at])) | ((a - at <= NEAR) & (doc[np.clip(a, None, len(h) - 1)] == doc[at]))
    upper = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kind == A.UPPER, out=upper[1:])
    shouting = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    # Tokens between spaces that mix letters with digits or inner signs, read without the signs
    gap = (kind == A.SPACE) | (kind == A.NEWLINE)
    letter = (kind == A.LOWER) | (kind == A.UPPER)
    odd = ~letter & ~gap
    inner = odd.copy()
    inner[1:] &= letter[:-1] | odd[:-1]
    inner[0] = False
    inner[:-1] &= letter[1:] | odd[1:]
    inner[-1] = False
    some = np.flatnonzero(np.diff(offsets))  # what stands beside a text is no neighbour
    inner[offsets[some]] = inner[offsets[some + 1] - 1] = False
    s2, e2 = A.word_spans(~gap, offsets)
    count = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(inner, out=count[1:])
    mixed = count[e2] - count[s2] > 0
    np.cumsum(letter, out=count[1:])
    mixed &= count[e2] - count[s2] >= 2
    s2, e2 = s2[mixed], e2[mixed]
    found = np.zeros(0, np.int64)
    d2 = np.searchsorted(offsets, s2, side="right") - 1
    if len(s2):
        size = e2 - s2
        base = np.cumsum(size) - size
        where = np.repeat(s2 - base, size) + np.arange(int(size.sum()))
        sym = leet[codes[where]]
        keep = sym > 0
        owner = np.repeat(np.arange(len(s2)), size)[keep]
        left = np.bincount(owner, minlength=len(s2))
        some = np.flatnonzero(left > 0)
        e3 = np.cumsum(left)
        got = masked.find(A.span_hashes(sym[keep], (e3 - left)[some], e3[some])) >= 0
        whole = np.zeros(len(s2), bool)
        whole[some[got]] = True
        flat = np.searchsorted(starts, s2)  # a plain word that only touches a sign counts once
        simple = np.zeros(len(s2), bool)
        ok = flat < len(starts)
        simple[ok] = fixed[flat[ok]] & (starts[flat[ok]] < e2[ok])
        found = d2[whole & ~simple]
    rate = lambda c: np.log1p(1000 * c / np.maximum(words, 1))
    lex, hid = np.bincount(doc[fixed], minlength=n), np.bincount(found, minlength=n)
    cols = [
        rate(np.bincount(doc[learnt], minlength=n)), rate(np.bincount(doc, weight, minlength=n)), rate(lex), rate(hid), rate(lex + hid), rate(np.bincount(doc[close], minlength=n)), rate(np.bincount(doc[you], minlength=n)), rate(np.bincount(doc[shouting], minlength=n)),
        rate(per_doc(codes == 33, offsets)), rate(per_doc((kind == A.PUNCT) | (kind == A.SYMBOL), offsets)), rate(np.bincount(d2, minlength=n)), np.log1p(words),
    ]
    return np.stack(cols, 1).astype(float)


class Model:
    """Features, trees and calibration together: scores of texts."""

    def __init__(self, mined: tuple, trees: gbt.Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.mined, self.trees, self.knots = mined, trees, knots

    def features(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return features(codes, offsets, self.mined)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), *self.knots)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    keys, weights = _mined(docs, labels, rows)
    mined = (A.HashIndex(keys), weights)
    x, y, ids = sample(docs, labels, "toxic", lambda c, o: features(c, o, mined), rows, where=F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) >= 2)
    held = np.arange(len(y)) % 2 == 1
    trees = gbt.fit(x[~held], y[~held], MONOTONE, rounds=40, depth=3, least=4)
    if not held.any():
        return Model(mined, trees, (np.array([0.0]), np.array([0.5])))
    return Model(mined, trees, gbt.isotonic(trees.margin(x[held]), y[held]))


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """``docs`` with the calibrated probability of toxicity, and that column's name."""
    model = fit(docs, labels, rows)
    return scored(docs, model.features, model, "toxicity")


def flagged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """The rows of score() above ``threshold``."""
    out, name = score(docs, labels, rows)
    return out.where(F.col(name) > threshold), name
