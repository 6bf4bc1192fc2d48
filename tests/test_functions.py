from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsgraph import functions as fn
from tests.helpers import column

NUMBERS = [
    "12", " 12 ", "1_000", "1__0", "_1", "1_", "1e3", "1E-3", "nan", "-inf", "Infinity", "1d", "12f", "5.", "-.5", ".",
    "0x10", "9" * 30, "2021-11-06", "٣", "1_0.5_0", "+7", "--7", "1.2.3", "e5", "abc", "1 2", "\t8\n", "١.٥", "1e", "½",
]


def python_guess(value):
    if value in (None, "", "null"):
        return None
    for kind, parse in (("integer", int), ("float", float)):
        try:
            parse(value)
            return kind
        except ValueError:
            pass
    return "string"


def guesses(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return column(df.select(fn.guess_type(F.col("v")).alias("g")), "g")


def test_type_guess_agrees_with_python_number_parsing(spark):
    values = [*NUMBERS, "", "null", None]
    assert guesses(spark, values) == [python_guess(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789_+-.eE naif", max_size=8), min_size=50, max_size=200))
def test_type_guess_on_generated_text(spark, values):
    assert guesses(spark, values) == [python_guess(v) for v in values]


def test_datetime_guess_is_optional(spark):
    df = spark.createDataFrame([("2021-11-06 10:00:00",)], "v string")
    assert column(df.select(fn.guess_type(F.col("v")).alias("g")), "g") == ["string"]
    assert column(df.select(fn.guess_type(F.col("v"), guess_datetime=True).alias("g")), "g") == ["datetime"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), min_size=20, max_size=100))
def test_iri_quote_agrees_with_percent_encoding(spark, values):
    values = [*values, "a b/c~d*e+f", "http://x.y/z?q=1&r=ü#t", "100%", "'\"<>"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    quoted = df.select(fn.iri_quote(F.col("v")).alias("a"), F.expr(fn.iri_quote_sql("v")).alias("b"))
    assert column(quoted, "a") == [quote(v) for v in values]
    assert column(quoted, "b") == [quote(v) for v in values]


def test_small_functions(spark):
    df = spark.createDataFrame([("ns#a#b",), ("plain",), ("",), (None,)], "v string")
    v = F.col("v")
    assert column(df.select(fn.strip_namespace(v).alias("x")), "x") == ["a#b", "plain", "", None]
    assert column(df.select(fn.null_text(v).alias("x")), "x") == ["ns#a#b", "plain", "null", "null"]
    one = spark.range(1)
    maps = one.select(
        fn.decode_json_map(F.lit('{"a":1,"b":null}')).alias("good"), fn.decode_json_map(F.lit("{oops")).alias("bad")
    ).first()
    assert maps["good"] == {"a": "1", "b": None}
    assert maps["bad"] == {}
    seconds = fn.elapsed_seconds(F.lit("2021-01-01 00:00:00"), F.lit("2021-01-01 00:01:00.5"))
    assert one.select(seconds.alias("s")).first()["s"] == 60.5


# Golden numbers: the saved label and domain reports.
LABEL_COUNTS = {
    "political": 9776, "fake": 7081, "conspiracy": 3512, "bias": 2793, "clickbait": 1238, "junksci": 993, "": 990,
    "unreliable": 437, "unknown": 354, "reliable": 178, "satire": 99, "hate": 81, "rumor": 57,
}


def test_percent_of_total_matches_the_saved_report(spark):
    df = spark.createDataFrame(list(LABEL_COUNTS.items()), "label string, url_count long")
    found = {r["label"]: r["pct"] for r in fn.percent_of_total(df, "url_count", "pct").collect()}
    assert found["political"] == pytest.approx(35.43441226575809)
    assert found["rumor"] == pytest.approx(0.20660408133676467)
    assert sum(found.values()) == pytest.approx(100)
