"""PII: information-theoretic sanitisation.

Values are found by their form: e-mail and IP addresses, telephone, card and account numbers, social security numbers,
keys and other secrets; numbers that carry a checksum need to fulfil it. Each value stands for up to three protected
entities: itself, its owner (the domain of an address, the network of an IP address, the prefix of a number) and its
kind. A value discloses itself and is generalised to its kind. A term (word) discloses entity c if the pointwise
mutual information PMI(c; t) = log p(c|t)/p(c) reaches ``DISCLOSURE`` of the information content IC(c) = -log p(c),
where p(c|t) is the share of the term's occurrences, over all documents, that lie within ``WINDOW`` words of c, and
p(c) the share of all words that do. Estimates need ``SUPPORT`` different contexts: copies of one passage are one
context. A disclosing term is generalised wherever it occurs ([NUMBER], [NAME] or [TERM]); one of which at least
``REMOVAL`` of the information content is disclosed is removed.

Corpus counts cover all documents. Up to ``BROADCAST_TERMS`` candidate terms are looked up in memory while the words
are counted; more are counted by joining each run's words to them. As many disclosing terms are looked up at once;
more are looked up part by part in the unchanged texts, which are rewritten once.

Defined results: a null text stays null with null counts, an empty text stays empty; texts without entity and term
come back unchanged, byte for byte; every row is rewritten by itself and repeated rows alike; an empty table gives
an empty result; other columns are carried along, and result columns whose names are taken get underscores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import column_of, extended, kept, scope, staged

WINDOW = 5
SUPPORT = 3
DISCLOSURE = 0.95
REMOVAL = 0.995
BROADCAST_TERMS = 2_000_000

#: Kinds in the order in which they are tried at a place of the text.
FORMS = {
    "SECRET": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:gh[pousr]_|sk[-_](?:live[-_])?|xox[abpr]-)[A-Za-z0-9_\-]{10,}"
    r"|(?<![^\s\"'=:])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{32,}={0,2}|(?i:password|passwd|pwd|secret|token|api_?key)[\"']?\s?[=:]\s?[\"']?(?P<VALUE>[^\s\"']{8,})|\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    "EMAIL": r"(?<![\w.+%\-])[\w.+%\-]++@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}",
    "IP": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ACCOUNT": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "SSN": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "PHONE": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<!\w)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\- ]\d{4}(?!\w)|(?<!\w)\d{3} \d{3} \d{4}(?!\w)|(?<!\w)0\d(?:[ .]\d\d){4}(?!\w)",
    "CARD": r"(?<![\w.\-])[2-6](?:[ \-]?\d){12,18}(?![\w\-])",
}
_ENTITY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()))


def _loosened(form: str) -> str:
    """A form for a linear engine, which may match more: without assertions and the local part of an address."""
    form = re.sub(r"\(\?<?[=!][^()]*\)|\\b", "", form)
    form = form.replace("(?P<VALUE>", "(?:").replace(r"[^\W\d_]", r"[\pL\pM\pN]").replace(r"[\w.+%\-]++@", "@").replace("++", "+").replace("*+", "*")
    return form.replace(r"[\w\-]", r"[\pL\pM\pN_\-]").replace(r"\d", r"\p{Nd}").replace(r"\s?", r"[\s\pZ\x0b\x1c-\x1f\x85]?").replace(r"[^\s\"']", r"[^\"']")


#: Whatever matches a form matches this, which a linear engine tests first: it is made of the forms.
_MAYBE = "|".join(map(_loosened, FORMS.values()))


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _sound(kind: str, value: str) -> bool:
    """Whether a number fulfils the checksum and ranges of its kind."""
    if kind == "CARD":
        return _luhn([int(c) for c in value if c.isdecimal()])
    if kind == "ACCOUNT":
        plain = value.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "SSN":
        area = int(value[:3])
        return 0 < area < 900 and area != 666 and int(value[4:6]) > 0 and int(value[7:]) > 0
    return True


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all protected values, in order and without overlap."""
    out, at = [], 0
    while m := _ENTITY.search(text, at):
        kind = m.lastgroup
        at = m.end()
        if _sound(kind, m.group()):
            out.append((*(m.span("VALUE") if m["VALUE"] else m.span()), kind))
    return out


def owner(kind: str, value: str) -> str | None:
    """Whose a value is as far as it tells: a domain, a network, the prefix of a number."""
    digits = "".join(c for c in value if c.isdecimal())
    if kind == "EMAIL":
        return value.rpartition("@")[2].lower()
    if kind == "IP":
        return value.rpartition(":" if ":" in value else ".")[0].lower()
    if kind == "PHONE":
        return digits[:-4]
    if kind == "CARD":
        return digits[:6]
    if kind == "ACCOUNT":
        return value.replace(" ", "")[:8]
    return None


def _protected(kind: str, value: str) -> list[int]:
    """Hashes of the entities that a value stands for."""
    of = owner(kind, value)
    return [A.hash_word(x) for x in (f"{kind} value {value.strip().lower()}", f"{kind} owner {of}" if of else None, f"{kind} any") if x]


def _words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = A.folded()[codes]
    starts, ends = A.word_spans(low > 0, offsets)
    return starts, ends, A.span_hashes(low, starts, ends)


def _maybe(column: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(column, _MAYBE).to_numpy(zero_copy_only=False))


def _contexts(window: int):
    """Rows (entity, context, term): the words within ``window`` words of each entity; term 0 counts the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = A.as_text(batch.column("text"))
            rows = _maybe(text)
            if not len(rows):
                continue
            for lo, hi, codes, offsets in A.sub_batches(text.take(pa.array(rows))):
                starts, ends, h = _words(codes, offsets)
                first = np.searchsorted(starts, offsets)
                e, c, t = [], [], []
                for i, t_ in enumerate(text.take(pa.array(rows[lo:hi])).to_pylist()):
                    for a, b, kind in entities(t_):
                        x = np.searchsorted(starts, offsets[i] + a)
                        y = np.searchsorted(starts, offsets[i] + b)
                        near = np.concatenate([h[max(first[i], x - window) : x], h[y : min(first[i + 1], y + window)]])
                        of = _protected(kind, t_[a:b])
                        if len(near):
                            ctx = int(A.mix(np.array([np.add.reduce(near * (np.arange(len(near), dtype=A.U64) * A.U64(2) + A.U64(1)))], A.U64))[0])
                        else:
                            ctx = of[0]
                        terms = np.unique(np.append(near, A.U64(0)))
                        e.append(np.repeat(np.array(of, A.U64), len(terms)))
                        c.append(np.full(len(terms) * len(of), ctx, A.U64))
                        t.append(np.tile(terms, len(of)))
                if e:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (e, c, t)], names=["entity", "context", "term"])

    return run


def _counts(terms: np.ndarray | None):
    """Rows (term, n) of each run: occurrences of the given terms, or of all words; term 0 counts all words."""
    lookup = None if terms is None else A.HashIndex(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0 if terms is None else len(terms), np.int64)
        words = 0
        for batch in batches:
            for _, _, codes, offsets in A.sub_batches(batch.column("text")):
                h = _words(codes, offsets)[2]
                words += len(h)
                if lookup is not None:
                    at = lookup.find(h)
                    total += np.bincount(at[at >= 0], minlength=len(total))
                else:
                    key, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])
        key = np.append(terms[total > 0], A.U64(0)) if lookup is not None else np.zeros(1, A.U64)
        n = np.append(total[total > 0], words) if lookup is not None else np.array([words])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    return run


def disclosing(
    docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, removal: float = REMOVAL, broadcast_terms: int = BROADCAST_TERMS
) -> DataFrame:
    """(term, gone): hashes of the terms that disclose an entity, and whether they are to be removed; staged."""
    with scope():
        return kept(_disclosing(docs, window, support, disclosure, removal, broadcast_terms))


def _disclosing(docs: DataFrame, window: int, support: int, disclosure: float, removal: float, broadcast_terms: int) -> DataFrame:
    text = docs.select(column_of(docs, "text", "string")).where("text is not null")
    near = staged(text.mapInArrow(_contexts(window), "entity bigint, context bigint, term bigint"))
    same = near.groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.count_distinct("context").alias("contexts"))
    same = staged(same.where((F.col("term") == 0) | (F.col("contexts") >= support)))
    terms = staged(same.where("term <> 0").select("term").distinct())
    many = terms.count()
    if many == 0:
        found = text.sparkSession.createDataFrame([], "term bigint, gone boolean")
        return staged(found)
    if many <= broadcast_terms:
        counted = text.mapInArrow(_counts(np.sort(terms.toArrow().column("term").to_numpy().view(A.U64))), "term bigint, n bigint")
    else:
        counted = text.mapInArrow(_counts(None), "term bigint, n bigint")
        counted = counted.join(terms.union(terms.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("term"))), "term", "left_semi")
    counted = staged(counted.groupBy("term").agg(F.sum("n").alias("n_t")))
    words = counted.where("term = 0").first()["n_t"]
    of = same.where("term = 0").select("entity", F.col("n_ct").alias("n_c"))
    both = same.where("term <> 0").join(of, "entity").join(counted, "term")
    p = F.least(F.col("n_c") * (2 * window) / F.lit(words), F.lit(1.0))
    share = F.least(F.col("n_ct") / F.col("n_t"), F.lit(1.0))
    pmi, ic = F.log(share / p), -F.log(p)
    told = both.withColumn("told", pmi / ic).where((ic > 0) & (F.col("told") >= disclosure))
    return staged(told.groupBy("term").agg((F.max("told") >= removal).alias("gone")))


def _general(word: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitize(docs: DataFrame, **options) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with rewritten texts, ``n_entities`` and ``n_terms``, and the names of these two columns.

    Options are those of disclosing().
    """
    found = disclosing(docs, **options)
    most = options.get("broadcast_terms", BROADCAST_TERMS) or 1
    parts = (found.count() - 1) // most + 1
    marked, own = extended(docs, {"marks": T.ArrayType(T.LongType())})
    at, out = docs.columns.index("text"), docs
    for part in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(_lookup(found.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)))
        if part < parts - 1:
            out = out.mapInArrow(_mark(shared, at, marked.fieldNames(), part > 0), marked)
    schema, names = extended(docs, {"n_entities": T.LongType(), "n_terms": T.LongType()})
    if not parts:
        shared = docs.sparkSession.sparkContext.broadcast(_lookup(found))
    return out.mapInArrow(_rewrite(shared, at, schema.fieldNames(), parts > 1), schema), names


def _lookup(found: DataFrame) -> tuple[A.HashIndex, np.ndarray]:
    own = found.orderBy("term").toArrow()
    return A.HashIndex(own.column("term").to_numpy().astype(np.int64).view(A.U64)), own.column("gone").to_numpy().astype(bool)


def _marks(text: pa.Array, lookup: A.HashIndex, gone: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(start, end, whether it goes) of the disclosing terms of each row that has any."""
    marks: dict[int, list[tuple[int, int, int]]] = {}
    if not len(gone):
        return marks
    for lo, _, codes, offsets in A.sub_batches(text):
        starts, ends, h = _words(codes, offsets)
        which = lookup.find(h)
        hit = np.flatnonzero(which >= 0)
        doc = np.searchsorted(offsets, starts[hit], side="right") - 1
        for d, s, e, g in zip(doc.tolist(), (starts[hit] - offsets[doc]).tolist(), (ends[hit] - offsets[doc]).tolist(), gone[which[hit]].tolist()):
            marks.setdefault(lo + d, []).append((s, e, g))
    return marks


def _carried(column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    return {i: list(zip(m[::3], m[1::3], m[2::3])) for i, m in enumerate(column.to_pylist()) if m}


def _mark(shared, at: int, names: list[str], again: bool):
    """Adds the marks of one part of the terms to the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            marks = _carried(cols.pop()) if again else {}
            for i, m in _marks(A.as_text(batch.column(at)), *shared.value).items():
                marks.setdefault(i, []).extend(m)
            flat = [[int(x) for m in marks.get(i, ()) for x in m] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(flat, pa.list_(pa.int64()))], names=names)

    return run


def _rewrite(shared, at: int, names: list[str], marked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            text = A.as_text(batch.column(at))
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            changed: dict[int, str] = {}
            n_e, n_t = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            marks = _carried(cols.pop()) if marked else {}
            for i, m in _marks(text, *shared.value).items():
                marks.setdefault(i, []).extend(m)
            for i in sorted({*_maybe(text).tolist(), *marks}):
                t = text[i].as_py()
                spans = [(a, b, f"[{kind}]") for a, b, kind in entities(t)]
                n_e[i] = len(spans)
                taken = np.array([[a, b] for a, b, _ in spans], np.int64).reshape(-1, 2)
                for s, e, gone in marks.get(i, ()):
                    k = int(np.searchsorted(taken[:, 1], s, side="right"))
                    if k == len(taken) or taken[k, 0] >= e:
                        spans.append((s, e, "" if gone else _general(t[s:e])))
                        n_t[i] += 1
                if not spans:
                    continue
                spans.sort()
                parts, last = [], 0
                for a, b, new in spans:
                    parts += [t[last:a], new]
                    last = b
                changed[i] = "".join([*parts, t[last:]])
            if changed:
                new = text.to_pylist()
                for i, t in changed.items():
                    new[i] = t
                cols[at] = pa.array(new, pa.string(), mask=null)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_e, mask=null), pa.array(n_t, mask=null)], names=names)

    return run
