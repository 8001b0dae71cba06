import random

import pytest
from pyspark.sql import functions as F

from bulaq.functions import sentence_rules
from bulaq.functions import text as X


def each(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("o"))
    return [r["o"] for r in rows.orderBy("i").collect()]


def test_casing(spark):
    assert each(spark, ["İstanbul", "QIZIL", "İİİ", None], X.lower) == ["istanbul", "qızıl", "iii", None]
    assert each(spark, ["istanbul", "qızıl"], X.upper) == ["İSTANBUL", "QIZIL"]


def test_translit(spark):
    pairs = {"Азәрбајҹан": "Azərbaycan", "Ил": "İl", "ЫЛДЫЗ": "ILDIZ", "июн": "iyun", "Юбилей": "Yubiley", "ЮНЕСКО": "YUNESKO", "объект": "obekt", "Latın": "Latın"}
    assert each(spark, list(pairs), X.to_latin) == list(pairs.values())
    assert each(spark, ["aбc", "abc"], X.contains_cyrillic) == [True, False]


def test_normalizer(spark):
    n = X.Normalizer()
    got = each(spark, ["a  b\t c", "a\n\n\n\nb", "", "a\n \n \nb", "“Ǝ” – x z\x01y", "é"], n)
    assert got == ["a b c", "a\n\nb", "", "a\n\n\nb", '"Ə" - x z y', "é"]
    assert each(spark, ["ABI"], X.Normalizer(form=None, lowercase=True, extra_steps=(X.python_step(lambda s: s + "!"),))) == ["abı!"]


@pytest.mark.parametrize(
    "text, n",
    [("Prof. Əliyev gəldi. Sonra getdi.", 2), ("H. Əliyev yazdı.", 1), ("3. Maddə budur. Bəli.", 2), ("A? B! C.", 3), ("", 0), ("İldə 2020. Sonra", 1), ('Dedi "söz." Getdi.', 2)],
)
def test_sentences(spark, text, n):
    got = each(spark, [text], X.sentences)[0]
    assert len(got) == n and got == sentence_rules.split(text)


def test_sentences_agree_on_random_text(spark):
    r = random.Random(3)
    parts = ["məs", "H", "2.1", "söz", "MIN", "min", ".", ". ", "? ", '." ', "… ", " ", "\n", "Ə", "(a) ", "e.ə", "12"]
    texts = ["".join(r.choice(parts) for _ in range(30)) for _ in range(200)]
    assert each(spark, texts, X.sentences) == [sentence_rules.split(t) for t in texts]


def test_dates(spark):
    pairs = {"15 iyun 2022": "2022-06-15", "15 IYUN 2022": "2022-06-15", "2024-99-99": "2024-99-99", "1.2.2020": "2020-02-01", "45.13.2020 5 may": "2026-05-05", "yox": None, "3 martda 2019": "2026-03-03"}
    assert each(spark, list(pairs), lambda c: X.extract_date(c, 2026)) == list(pairs.values())


def test_small_functions(spark):
    assert each(spark, ["d"], lambda c: X.chunk_id(c, F.lit(12345)))[0] == "d::12345"
    assert each(spark, ["  ", "x" * 20000], lambda c: F.length(X.api_text(c))) == [1, 16000]
    assert each(spark, ["a\nb" * 10], lambda c: X.truncate(c, 5)) == ["a ba…"]
