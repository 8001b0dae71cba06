"""Scalar text functions as Column expressions; only Unicode composition needs Python, and there Arrow."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "A-ZÇƏĞİÖŞÜ"
LOWER = "a-zçəğıöşü"
#: White space as Unicode and the control separators define it, for Java patterns; without and with the newline.
BLANK = r"\t\x0B\f\r \x1C-\x1F\x85   -     　"
SPACE = BLANK + r"\n"
#: Private characters: a stop that ends no sentence, and the end of one.
_HELD, _CUT = "", ""

_REPAIR = {
    **dict.fromkeys("ƎӘ", "Ə"), **dict.fromkeys("ǝә", "ə"), **dict.fromkeys("‘’ʼ´`", "'"),
    **dict.fromkeys("“”«»", '"'), **dict.fromkeys("–—", "-"), " ": " ",
}
_SINGLE = dict(zip("абвгғдеәжзиыјкҝлмноөпрстуүфхһчҹшйэ", "abvqğdeəjziıykglmnoöprstuüfxhçcşye"))
_MULTI = {"ю": "yu", "я": "ya", "ё": "yo", "ц": "ts", "щ": "şş"}
_ABBREVIATIONS = "məs b s səh c e.ə h m t prof akad dos dr müəl qəs r ş küç pr man qəp mln mlrd min".split()


def az_upper(s: str) -> str:
    return s.replace("i", "İ").replace("ı", "I").upper()


def az_lower(s: str) -> str:
    return s.replace("İ", "i").replace("I", "ı").lower()


def lower(c: Column) -> Column:
    """Lower case with dotted and dotless i kept apart."""
    return F.lower(F.translate(c, "İI", "iı"))


def upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def repair(c: Column) -> Column:
    """Look-alike letters, quotes, dashes and hard spaces replaced by the plain characters."""
    return F.translate(c, "".join(_REPAIR), "".join(_REPAIR.values()))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


def collapse(c: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more newlines to two, then every line stripped."""
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, f"(?dm)^[{BLANK}]+|[{BLANK}]+$", "")


def contains_cyrillic(c: Column) -> Column:
    return c.rlike(r"[\u0400-\u04FF]")


def to_latin(c: Column) -> Column:
    """Cyrillic letters to Latin ones; a letter of two is all upper case where the next one is upper case. Other texts pass as they are."""
    given = c
    for low, to in _MULTI.items():
        up = az_upper(low)
        c = F.regexp_replace(c, f"{up}(?=\\p{{Lu}})", az_upper(to))
        c = F.replace(F.replace(c, F.lit(up), F.lit(az_upper(to[0]) + to[1:])), F.lit(low), F.lit(to))
    low, to = "".join(_SINGLE), "".join(_SINGLE.values())
    return F.when(contains_cyrillic(given), F.translate(c, low + low.upper() + "ъьЪЬ", to + az_upper(to))).otherwise(given)


#: Rows whose texts are Python strings at once; an Arrow batch has up to 10,000.
RUN_ROWS = 64


def composed(parts: Iterator[pa.Array], form: str) -> Iterator[pa.Array]:
    """The texts of Arrow arrays in that form, RUN_ROWS at most in each array."""
    for part in parts:
        for lo in range(0, max(1, len(part)), RUN_ROWS):
            yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in part.slice(lo, RUN_ROWS).to_pylist()], pa.string())
        del part


def compose(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form, for which Spark has no built-in function. A few texts at a time become Python strings."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from composed(parts, form)

    return run(c)


class Normalizer:
    """Column to Column: the stages in their fixed order, each of which can be left out, then steps of the caller's own."""

    def __init__(
        self, form: str | None = "NFC", controls: bool = True, transliterate: bool = True, repairs: bool = True, whitespace: bool = True,
        lowercase: bool = False, extra_steps: tuple[Callable[[Column], Column], ...] = (),
    ):
        self.form, self.controls, self.transliterate, self.repairs = form, controls, transliterate, repairs
        self.whitespace, self.lowercase, self.extra_steps = whitespace, lowercase, tuple(extra_steps)

    def __call__(self, c: Column) -> Column:
        if self.form:
            c = compose(c, self.form)
        if self.controls:
            c = strip_controls(c)
        if self.transliterate:
            c = to_latin(c)
        if self.repairs:
            c = repair(c)
        if self.whitespace:
            c = strip(collapse(c))
        if self.lowercase:
            c = lower(c)
        for step in self.extra_steps:
            c = step(c)
        return c


def python_step(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A step from a Python function of one string, run on Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


def _any_case(word: str) -> str:
    return "".join({"i": "[iİ]", "ı": "[ıI]", ".": r"\."}.get(x, f"[{x}{x.upper()}]") for x in word)


PROTECTED = rf"(?U)(?<![^\s\x1C-\x1F])((?-U:[{UPPER}])|{'|'.join(map(_any_case, _ABBREVIATIONS))}|\d+(?:\.\d+)*)\.(?=[\s\x1C-\x1F])"
BOUNDARY = rf"(?<=[.!?…])([)\"']*[{SPACE}]+)(?=[{UPPER}0-9\"'(\-])"


def sentences(c: Column) -> Column:
    """Array of sentences. A stop after an initial, an abbreviation or a number does not end one."""
    marked = F.regexp_replace(F.regexp_replace(c, PROTECTED, "$1" + _HELD), BOUNDARY, "$1" + _CUT)
    parts = F.transform(F.split(marked, _CUT), lambda s: strip(F.replace(s, F.lit(_HELD), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


_DIGITS = [c for c in map(chr, range(0x110000)) if unicodedata.decimal(c, None) is not None and c not in "0123456789"]


def whole_number(c: Column) -> Column:
    """Decimal digits of any script as BIGINT; null where there are none or too many."""
    plain = F.translate(c, "".join(_DIGITS), "".join(str(unicodedata.decimal(d)) for d in _DIGITS))
    return plain.try_cast("bigint")


_MONTHS = ["yanvar", "fevral", "mart", "aprel", "may", "iyun", "iyul", "avqust", "sentyabr", "oktyabr", "noyabr", "dekabr"]
MONTHS = "|".join(_MONTHS)
_MONTH_ANY = "|".join(m.replace("i", "[iİıI]") for m in _MONTHS)


def extract_date(c: Column, default_year: int | None = None) -> Column:
    """First date as ISO text: an ISO one, else day.month.year, else day and month name with a year or the default one."""
    iso = F.regexp_extract(c, r"(?U)\b(\d{4}-\d{2}-\d{2})\b", 1)
    num = r"(?U)\b(\d{1,2})[./](\d{1,2})[./](\d{4})\b"
    text = rf"(?Uiu)\b(\d{{1,2}})\s+({_MONTH_ANY})\s*(\d{{4}})?"
    part = lambda p, i: F.regexp_extract(c, p, i)
    number = whole_number
    d, m, y = (number(part(num, i)) for i in (1, 2, 3))
    by_number = F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))
    d2 = number(part(text, 1))
    name = F.translate(F.lower(F.translate(part(text, 2), "İI", "ii")), "ı", "i")
    m2 = F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("int")
    y2 = F.coalesce(number(part(text, 3)), F.lit(default_year).cast("int"))
    by_name = F.when((y2 > 0) & d2.between(1, 31), F.format_string("%04d-%02d-%02d", y2, m2, d2))
    return F.coalesce(F.nullif(iso, F.lit("")), by_number, by_name)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.format_string("%s::%04d", doc, index.cast("int"))


def api_text(c: Column, limit: int = 16_000) -> Column:
    """Text for a remote model: stripped, never empty, bounded by what the model takes."""
    s = strip(c)
    return F.left(F.when(s == "", F.lit(" ")).otherwise(s), F.lit(limit))


def truncate(c: Column, limit: int) -> Column:
    s = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - 1)), F.lit("…"))).otherwise(s)
