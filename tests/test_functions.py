import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinarium.functions.numbers import fixed, rounded, thousands
from opinarium.functions.reviews import day_of, has_image, price_bracket, sentiment_of
from opinarium.functions.text import clip_marked, render, split_lines, strip


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


@settings(max_examples=10, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.floats(-1, 1), st.integers(-4000, 4000).map(lambda i: i / 40)), min_size=40, max_size=300))
def test_fixed_equals_python_format(spark, numbers):
    df = spark.createDataFrame([(float(x),) for x in numbers], "x double")
    got = df.select(*[fixed(F.col("x"), d).alias(str(d)) for d in range(4)]).collect()
    for x, row in zip(numbers, got):
        for d in range(4):
            want = f"{float(x):.{d}f}"
            assert row[str(d)] == (want[1:] if x == 0 and want[0] == "-" else want)


def test_fixed_halves_and_gaps(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (0.15,), (4.35,), (None,), (99.99999,)], "x double")
    assert values(df, fixed(F.col("x"), 0)) == ["0", "2", "0", "4", None, "100"]
    assert values(df, fixed(F.col("x"), 1)) == ["0.5", "2.5", "0.1", "4.3", None, "100.0"]
    assert values(df, rounded(F.col("x"), 2))[2:4] == [0.15, 4.35]


def test_thousands(spark):
    assert values(spark.range(1).select(F.lit(1234567).alias("n")), thousands(F.col("n"))) == ["1,234,567"]


SPACES = "\n\t\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0       　"


@pytest.mark.parametrize("text", ["\na\t", SPACES + "a b" + SPACES, "", SPACES, "a\n", "a\n\nb \n"])
def test_strip_equals_python(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert values(df, strip(F.col("s"))) == [text.strip()]


@pytest.mark.parametrize("text", ["a\r\nb\rc\n\nd\x0be\x0cf\x1cg\x85h i ", "", "\n", "one"])
def test_split_lines_equals_python(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    want = [line.strip() for line in text.splitlines() if line.strip()]
    assert values(df, split_lines(F.col("s"))) == [want]


def test_marker_only_when_cut(spark):
    df = spark.createDataFrame([("x" * 400,), ("x" * 401,), ("é" * 401,)], "s string")
    assert values(df, clip_marked(F.col("s"), 400, "...")) == ["x" * 400, "x" * 400 + "...", "é" * 400 + "..."]


def test_render_fills_places_and_nulls(spark):
    df = spark.createDataFrame([("q", None)], "a string, b string")
    assert values(df, render("<{a}|{b}>\n", a=F.col("a"), b=F.col("b"))) == ["<q|>\n"]


def test_labels(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "r int")
    assert values(df, sentiment_of(F.col("r"))) == ["neg", "neg", "neu", "pos", "pos", None]


def test_brackets_are_half_open(spark):
    df = spark.createDataFrame([(0.0,), (24.99,), (25.0,), (200.0,), (-1.0,), (None,)], "p double")
    got = values(df, price_bracket(F.col("p"), (0, 25, 50, 100, 200)))
    assert got == ["0-25", "0-25", "25-50", "200+", None, None]


def test_day_of_texts(spark):
    df = spark.createDataFrame([("2020-01-31 10:00:00",), ("2020-02-30",), ("x",), (None,)], "d string")
    assert [str(v) for v in values(df, day_of(F.col("d")))] == ["2020-01-31", "None", "None", "None"]


def test_image_validity(spark):
    df = spark.createDataFrame([("u",), ("",), (None,)], "i string")
    assert [bool(v) for v in values(df, F.coalesce(has_image(F.col("i")), F.lit(False)))] == [True, False, False]
