import datetime

import pytest
from pyspark.sql import functions as F

import opinarium as op
from catalog.views import load
from opinarium.plans.metrics import first_images
from opinarium.plans.products import both_sides

SF = "/root/testdata/sf0.001"
REVIEWS = "review_id bigint, product_title string, rating int, sentiment string, review_date date, image_url string"


def day(text):
    return text and datetime.date.fromisoformat(text)


def reviews(spark, rows):
    return spark.createDataFrame([(i, t, r, s, day(d), u) for i, (t, r, s, d, u) in enumerate(rows)], REVIEWS)


def test_missing_labels_count_in_the_denominator(spark):
    df = reviews(spark, [("a", 5, "pos", None, None), (None, None, None, None, None), ("a", 1, "neg", None, None), ("b", 2, "neg", None, None)])
    row = op.kpi_overview(df).first()
    assert (row.total_reviews, row.pos_pct, row.neg_pct, row.unique_products) == (4, 25.0, 50.0, 2)
    assert row.avg_rating == pytest.approx(8 / 3)
    mix = {r.label: r.pct for r in op.sentiment_mix(op.kpi_overview(df)).collect()}
    assert mix == {"Positive": 25.0, "Negative": 50.0, "Neutral": 25.0}


def test_month_gaps_and_gate(spark):
    rows = [("a", 5, "pos", "2020-01-05", None), ("a", 5, None, "2020-01-06", None), ("a", 1, "neg", None, None),
            ("a", 1, "neg", "2020-03-01", None), ("a", 1, None, "2020-04-01", None), ("b", 5, "pos", "2020-01-05", None)]
    df = reviews(spark, rows)
    got = [(str(r.month), r.pos, r.neu, r.neg) for r in op.product_monthly(df).orderBy("month").collect()]
    assert got == [("2020-01-01", 1, 0, 0), ("2020-03-01", 0, 0, 1)]
    assert op.product_monthly(df, min_rows=6).count() == 0


def test_month_from_text_dates(spark):
    df = reviews(spark, [("a", 5, "pos", "2020-01-05", None)] * 5)
    as_text = df.withColumn("review_date", F.concat(F.col("review_date").cast("string"), F.lit(" 12:00:00")))
    assert op.product_monthly(as_text).collect() == op.product_monthly(df).collect()


def test_first_image_may_be_missing(spark):
    df = reviews(spark, [("a", 5, "pos", None, None), ("a", 5, "pos", None, "b")])
    assert first_images(df).first().image_url is None
    assert op.leaderboard(df).first().image_url is None


def test_trend_cuts_before_averaging(spark):
    start = datetime.date(2018, 1, 1)
    rows = [(start + datetime.timedelta(days=i), i, 0, 0) for i in range(800)]
    daily = spark.createDataFrame(rows, "date date, pos bigint, neu bigint, neg bigint")
    year = op.sentiment_trend(daily, "1Y").orderBy("date").collect()
    assert len(year) == 366 and year[0].pos == 434.0
    assert op.sentiment_trend(daily, "5Y").count() == 800


def test_five_years_are_1825_days(spark):
    start = datetime.date(2010, 1, 1)
    rows = [(start + datetime.timedelta(days=i), 1, 0, 0) for i in range(2000)]
    daily = spark.createDataFrame(rows, "date date, pos bigint, neu bigint, neg bigint")
    assert op.sentiment_trend(daily, "5Y").count() == 1826


def test_gate_needs_both_sides(spark):
    rows = [("a", "pos")] * 3 + [("a", "neg")] * 3 + [("b", "pos")] * 9 + [("b", "neg")] * 2
    df = spark.createDataFrame(rows, "t string, sentiment string")
    assert {r.t for r in both_sides(df, ["t"], 3).collect()} == {"a"}


def test_approximate_distinct(spark):
    rv = load(spark, SF, "rv")
    exact = op.kpi_overview(rv).first().unique_products
    assert abs(op.kpi_overview(rv, approximate=True).first().unique_products - exact) <= 0.05 * exact


def test_counts_agree(spark):
    rv = load(spark, SF, "rv")
    labelled = rv.filter("sentiment is not null").count()
    daily = op.daily_sentiment(rv).agg(F.sum(F.expr("pos + neu + neg"))).first()[0]
    stats = op.product_stats(rv).agg(F.sum("review_count")).first()[0]
    board = op.leaderboard(rv).collect()
    assert daily == labelled and stats == rv.count()
    assert all(abs(r.pos_pct + r.neu_pct + r.neg_pct - 1) < 1e-9 for r in board)


def test_aggregates_hash_and_prune(spark):
    plan = op.product_stats(load(spark, SF, "rv"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "l_shipdate" not in plan


def test_trend_has_no_single_task_window(spark):
    trend = op.sentiment_trend(op.daily_sentiment(load(spark, SF, "rv")), "1Y")
    plan = trend._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "windowspecdefinition(_block" in plan


def test_drilldown(spark):
    rows = [("a", 5, "pos", "2020-01-05", "u")] * 4 + [("a", 1, "neg", "2020-02-05", None)] * 3 + [("b", None, None, None, None)]
    got = {r.product_title: r for r in op.product_drilldown(reviews(spark, rows), text=("rating",)).collect()}
    a, b = got["a"], got["b"]
    assert (a.review_count, a.image_url, a.has_image, a.has_summary) == (7, "u", True, True)
    assert [(str(m.month), m.pos, m.neu, m.neg) for m in a.months] == [("2020-01-01", 4, 0, 0), ("2020-02-01", 0, 0, 3)]
    assert [r.review_id for r in a.top_pos] == [0, 1, 2] and [r.review_id for r in a.top_neg] == [4, 5, 6]
    assert (b.review_count, b.avg_rating, b.months, b.top_pos, b.has_summary) == (1, None, [], None, False)
