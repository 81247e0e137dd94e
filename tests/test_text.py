import pytest
from pyspark.sql import functions as F

from tamarack.functions import text as tx
from tamarack.operators.query import clean

SAMPLES = [
    None, "", "  Hello,  World!! ", "A_b|c — d–e", "C++ and C#; node.js / a/b testing", "Maine 5 saal ka kaam kiya, ek API banaya",
    "do das teen", "naïve ÉCOLE हि 東京", "tab\tnew\nline nbsp", "x@y.z (2020-2021)", "saal_ka", "“quoted” don't",
]


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("sample", SAMPLES)
def test_clean_agrees_with_the_drivers(spark, sample):
    assert one(spark, tx.clean(F.col("v")), sample) == clean(sample)


def test_nfkc_only_touches_what_is_not_ascii(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "ﬁne ½ ①"), (3, None)], "i int, v string")
    assert {r.i: r.v for r in df.select("i", tx.nfkc(df.v).alias("v")).collect()} == {1: "plain", 2: "fine 1⁄2 1", 3: None}


def test_tokens_counts_and_phrases(spark):
    assert one(spark, tx.tokens(F.lit("c++ node.js 3.5 a+b x."))) == ["c", "node.js", "3.5", "a+b", "x"]
    assert one(spark, tx.phrase_count(F.lit(" a a a b "), "a")) == " a a a b ".count(" a ")
    assert one(spark, tx.present(tx.found(F.lit("deep learning"), ["learning", "deep learning", "deep le"]), ["learning", "deep learning", "deep le"])) == ["learning", "deep learning"]
    assert one(spark, tx.has_any(tx.found(F.lit(""), ["", "x"]), ["", "x"])) is False


def test_sentences(spark):
    text = "Built search.  Led team! a | b; - last -;"
    assert one(spark, tx.sentences(F.lit(text))) == ["Built search", "Led team!", "a", "b", "last"]
    assert one(spark, tx.sentences(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), (" 7 ", 7.0), ("NaN", None), ("inf", None), ("x", None), ("", None)])
def test_numbers(spark, text, value):
    assert one(spark, tx.number(F.lit(text))) == value


def test_days(spark):
    assert str(one(spark, tx.day(F.lit("2026-03-01T10:00")))) == "2026-03-01"
    assert one(spark, tx.day(F.lit("2026-13-01"))) is None
    assert one(spark, tx.day(F.lit("March"))) is None


def test_flatten_goes_by_name(spark):
    df = spark.createDataFrame([({"b": "Two", "A": [1.5, None], "c": True},)], "r struct<b:string,A:array<double>,c:boolean>")
    assert df.select(tx.flatten(F.col("r"), df.schema["r"].dataType)).first()[0] == "1.5 two true"
