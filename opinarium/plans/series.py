"""Time series: daily counts, rolling trend, monthly counts per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinarium import fixed as V
from opinarium.functions.reviews import day_of, month_of
from opinarium.operators.rolling import rolling_mean


def _counts():
    return [F.count_if(F.col("sentiment") == label).alias(label) for label in V.SENTIMENTS]


def _day(reviews: DataFrame, date: str) -> Column:
    """The date column itself, or its parsed text."""
    is_text = isinstance(reviews.schema[date].dataType, T.StringType)
    return day_of(F.col(date)) if is_text else F.to_date(date)


def daily_sentiment(reviews: DataFrame, date: str = "review_date") -> DataFrame:
    """Reviews per day and sentiment. Conditional counts need one exchange, a pivot two."""
    by_day = reviews.groupBy(_day(reviews, date).alias("date")).agg(*_counts())
    return by_day.filter(F.col("date").isNotNull())


def sentiment_trend(daily: DataFrame, window: str = "ALL") -> DataFrame:
    """30-day rolling means; ``1Y`` and ``5Y`` first keep the last 365 or 1,825 days.

    The cut precedes the averaging, so the first days average what is left of their
    window. The last day is a scalar subquery, which Spark pushes below the daily
    aggregation into the scan.
    """
    if window != "ALL":
        start = daily.select(F.date_sub(F.max("date"), V.WINDOW_DAYS[window])).scalar()
        daily = daily.filter(F.col("date") >= start)
    return rolling_mean(daily, V.SENTIMENTS, V.ROLLING_DAYS)


def monthly_totals(reviews: DataFrame, date: str = "review_date") -> DataFrame:
    """Row, rating and sentiment totals per title and month; undated reviews form a null month."""
    return reviews.groupBy("product_title", month_of(_day(reviews, date)).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("rating").alias("stars"),
        F.count("rating").alias("rated"),
        *_counts(),
    )


def product_monthly(reviews: DataFrame, min_rows: int = V.SERIES_MIN_REVIEWS, date: str = "review_date") -> DataFrame:
    """Reviews per title, month and sentiment, for titles with at least ``min_rows`` reviews.

    Undated and unlabelled reviews count towards the minimum but form no month. The
    minimum is checked on monthly totals, never on a window over raw reviews.
    """
    monthly = monthly_totals(reviews.filter(F.col("product_title").isNotNull()), date)
    total = F.sum("rows").over(Window.partitionBy("product_title"))
    labelled = F.col("pos") + F.col("neu") + F.col("neg")
    return (
        monthly.withColumn("_total", total)
        .filter((F.col("_total") >= min_rows) & F.col("month").isNotNull() & (labelled > 0))
        .select("product_title", "month", *V.SENTIMENTS)
    )


def stacked(monthly: DataFrame) -> DataFrame:
    """Running sums over positive, neutral and negative, as a stacked area draws them."""
    return monthly.select(
        "product_title",
        "month",
        F.col("pos").alias("pos_top"),
        (F.col("pos") + F.col("neu")).alias("neu_top"),
        (F.col("pos") + F.col("neu") + F.col("neg")).alias("neg_top"),
    )
