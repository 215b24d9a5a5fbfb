import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limpid.functions import equality, kinds, numbers, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def each(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expression(F.col("v"))).collect()]


def test_number_readers(spark):
    values = ["1", "1.0", " 42 ", "1e3", "1_000", "1,234", "inf", "nan", "1d", "1f", "0x1F", "True", "+5", ".5", "5.", "", "abc", "--1", "1 2", "0010", None]
    plain = dict(zip(values, each(spark, values, numbers.to_number), strict=True))
    loose = dict(zip(values, each(spark, values, numbers.loose_number), strict=True))
    assert {k: v for k, v in plain.items() if v is not None} == {"1": 1, "1.0": 1, " 42 ": 42, "1e3": 1000, "+5": 5, ".5": 0.5, "5.": 5, "0010": 10}
    assert loose["1_000"] == 1000 and loose["1,234"] == 1234 and loose["1d"] is None and loose["1 2"] is None and loose["inf"] is not None


def test_half_even(spark):
    assert each(spark, [2.5, 3.5, 2.7, -0.5, None], numbers.half_even_integer, "double") == [2, 4, 3, 0, None]


@pytest.mark.parametrize(
    "value, kind",
    [
        ("Yes", "boolean"), ("12", "integer"), ("1,234", "integer"), ("2.0", "integer"), ("2.5", "float"), ("nan", "float"), ("2024-03-01", "datetime"), ("22 March 2014", "datetime"), ("Monday", "datetime"), ("10:30", "datetime"),
        ("$12", "dirty_integer"), ("12.5 kg", "dirty_float"), ("[1, 'a']", "collection"), ("{'a': 1}", "collection"), ("set()", "collection"), ("a;b", "delimited_string"), ("http://a/b", "discrete_string"), ("word", "discrete_string"),
        ("New York City", "named_entity"), ("this is a much longer piece of text", "natural_language_text"), ("the end", "natural_language_text"), ("  ", None), (None, None),
    ],
)
def test_kinds(spark, value, kind):
    assert each(spark, [value], kinds.value_kind) == [kind]


def test_kinds_of_fractions_and_empty_parts(spark):
    assert each(spark, ["1/2", "a,,b", "a|b", "a\\b", ","], kinds.is_delimited) == [False, False, True, True, False]


def test_signature(spark):
    assert each(spark, ["Brand#17", "", "a_B 9", "é.É", None], text.signature) == [r"^[A-Z][a-z]{4}\#\d{2}$", "^$", r"^[a-z]_[A-Z]\s\d$", r"^[a-z]\.[A-Z]$", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ9 .#_-b", max_size=8), min_size=1, max_size=12))
def test_signatures_match_their_text(spark, values):
    for value, pattern in zip(values, each(spark, values, text.signature), strict=True):
        assert re.fullmatch(pattern, value)


def test_noise_mask(spark):
    assert each(spark, ["$15", " 12.5 ", "91 kg", "a1b22", None], text.noise_mask) == ["${N}", None, "{N} kg", "a{N}b{N}", None]


def test_shortened_and_quoted(spark):
    assert each(spark, ["x" * 51, "x" * 50], text.shortened) == ["x" * 50 + "...", "x" * 50]
    assert each(spark, ['a"b', None], text.quoted) == ["\"a'b\"", "NaN"]
    assert each(spark, [0.123, None], text.percent, "double") == ["12.3%", "—"]


def test_markup(spark):
    assert each(spark, ["<p>a  b</p> http://x.y/z c"], text.strip_markup) == ["a b c"]


TABLE = [("20", "int", "20", "int", True, True), ("20", "text", "20", "int", True, False), ("20.0", "float", "20", "int", True, False), ("Utrecht", "text", "Utrecht", "text", True, True), ("utrecht", "text", "Utrecht", "text", False, False), (None, None, None, None, True, True), (None, None, "20", "int", False, False)]


def test_lenient_and_strict(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(TABLE)], "i int, a string, ak string, b string, bk string").orderBy("i")
    got = df.select(equality.lenient_equal(F.col("a"), F.col("b")), equality.strict_equal(F.col("a"), F.col("b"), F.col("ak"), F.col("bk"))).collect()
    assert [tuple(r) for r in got] == [r[4:] for r in TABLE]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "1", "1.0", "x", "nan"]), st.sampled_from([None, "1", "2", "x"])), min_size=1, max_size=20))
def test_strict_implies_lenient(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    kind = lambda c: F.when(F.col(c).isNull(), None).when(numbers.to_number(F.col(c)).isNotNull(), "float").otherwise("text")
    rows = df.select(equality.strict_equal(F.col("a"), F.col("b"), kind("a"), kind("b")).alias("s"), equality.lenient_equal(F.col("a"), F.col("b")).alias("l")).collect()
    assert all(r["l"] or not r["s"] for r in rows) and not any(r["s"] is None or r["l"] is None for r in rows)


def test_tolerances(spark):
    df = spark.createDataFrame([("0.0", "0.000000005"), ("1e9", "1000000000.5"), ("100", "101")], "a string, b string")
    assert [tuple(r) for r in df.select(equality.lenient_equal(F.col("a"), F.col("b")), equality.shown_equal(F.col("a"), F.col("b"))).collect()] == [(True, False), (True, True), (False, False)]
