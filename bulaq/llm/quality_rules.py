"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on a bounded labelled sample (``labelled.SAMPLE_ROWS``), flattened into numpy node arrays and
applied to whole batches. Shares of symbols, capitals, separators and repeated lines may only lower the quality.

Defined results: a null text has a null quality and is not kept, an empty one gets the score of all-zero
statistics and is not kept; rows are scored one by one, so repeated rows get equal scores; without labels every
text has the same score and is kept; an empty table gives an empty result; other columns are carried along, and a
result column whose name is taken gets underscores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from . import gbt
from .labelled import SAMPLE_ROWS, per_doc, sample, scored

NAMES = ["words", "word_length", "upper", "digits", "punctuation", "symbols", "spaces", "stops", "line_words", "repeated_lines", "distinct_words", "bare_symbols", "decorated_words", "upper_words", "exclamations"]
#: Quality may not rise with these: see NAMES.
MONOTONE = [0, 0, -1, 0, 0, -1, 0, 0, 0, -1, 0, -1, -1, -1, -1]
THRESHOLD = 0.5


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[first], minlength=n)


def statistics(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text."""
    n = len(offsets) - 1
    if len(codes) == 0:
        return np.zeros((n, len(NAMES)))
    kind = A.kinds()[codes]
    chars = np.diff(offsets)
    share = lambda a, b: a / np.maximum(b, 1)
    by = lambda *k: per_doc(np.isin(kind, k) if len(k) > 1 else kind == k[0], offsets)
    gap = (kind == A.SPACE) | (kind == A.NEWLINE)
    starts, ends = A.word_spans(~gap, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(doc, minlength=n)
    letter = (kind == A.LOWER) | (kind == A.UPPER)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    letters = total[ends] - total[starts]
    np.cumsum(kind == A.UPPER, out=total[1:])
    uppers = total[ends] - total[starts]
    np.cumsum(kind == A.SYMBOL, out=total[1:])
    symbols = total[ends] - total[starts]
    lines, line_ends = A.word_spans(kind != A.NEWLINE, offsets)
    line_doc = np.searchsorted(offsets, lines, side="right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    distinct_lines = _distinct(line_doc, A.span_hashes(codes, lines, line_ends), n)
    distinct_words = _distinct(doc, A.span_hashes(codes, starts, ends), n)
    w = np.maximum(words, 1)
    cols = [
        np.log1p(words), share(chars - by(A.SPACE, A.NEWLINE), words), share(by(A.UPPER), per_doc(letter, offsets)), share(by(A.DIGIT), chars),
        share(by(A.PUNCT), chars), share(by(A.SYMBOL), chars), share(by(A.SPACE, A.NEWLINE), chars), share(by(A.STOP), words), np.log1p(share(words, n_lines)),
        np.where(n_lines > 0, 1 - share(distinct_lines, n_lines), 0.0), distinct_words / w, np.bincount(doc[(letters == 0) & (symbols > 0)], minlength=n) / w,
        np.bincount(doc[(letters > 0) & (symbols > 0)], minlength=n) / w, np.bincount(doc[(letters > 1) & (uppers == letters)], minlength=n) / w, share(per_doc(codes == 33, offsets), words),
    ]
    return np.stack(cols, 1).astype(float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> gbt.Trees:
    x, y, _ = sample(docs, labels, "quality", statistics, rows)
    return gbt.fit(x, y, MONOTONE)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """``docs`` with the probability of good quality, and that column's name."""
    trees = fit(docs, labels, rows)
    return scored(docs, statistics, trees.probability, "quality_score")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """The rows of score() whose text has a letter or digit or other mark at all and whose score reaches ``threshold``."""
    out, name = score(docs, labels, rows)
    return out.where((F.col(name) >= threshold) & F.col("text").rlike(r"\S")), name
