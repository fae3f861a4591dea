"""Corpus-level numbers: overview, mix, price brackets and the leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium import fixed as V
from opinarium.functions.numbers import fixed, rounded, thousands
from opinarium.functions.reviews import bracket_order, price_bracket, share
from opinarium.functions.text import render

PRICE_EDGES = (0, 25, 50, 100, 200)
#: Size of a sketch as a power of two; 14 gives an error of about 1 %.
SKETCH_BITS = 14


def kpi_overview(reviews: DataFrame, approximate: bool = False) -> DataFrame:
    """Review count, mean rating, positive and negative share in percent, distinct titles.

    One pass. The exact distinct count first reduces to one row per title in every map
    task; ``approximate`` replaces it by a sketch of fixed size (error about 1 %).
    """
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("product_title", F.lit(SKETCH_BITS)))
    titles = sketch if approximate else F.countDistinct("product_title")
    sentiment = F.col("sentiment")
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.avg("rating").alias("avg_rating"),
        (share(sentiment, V.POSITIVE) * 100).alias("pos_pct"),
        (share(sentiment, V.NEGATIVE) * 100).alias("neg_pct"),
        titles.alias("unique_products"),
    )


def distinct_titles(reviews: DataFrame, log_size: int = SKETCH_BITS) -> DataFrame:
    """``unique_products`` and ``sketched``: the number of titles, exactly and by a sketch, in one scan.

    Titles are brought down to one row each before both are counted, so the sketch costs no exchange of its own.
    """
    titles = reviews.select("product_title").distinct()
    return titles.agg(
        F.count("product_title").alias("unique_products"),
        F.hll_sketch_estimate(F.hll_sketch_agg("product_title", F.lit(log_size))).alias("sketched"),
    )


def daily_titles(reviews: DataFrame, log_size: int = SKETCH_BITS) -> DataFrame:
    """``date, titles``: a sketch of the titles reviewed on each day, to be stored and merged over any days."""
    dated = reviews.filter(F.col("review_date").isNotNull() & F.col("product_title").isNotNull())
    return dated.groupBy(F.col("review_date").alias("date")).agg(
        F.hll_sketch_agg("product_title", F.lit(log_size)).alias("titles")
    )


def titles_between(daily: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """``sketched``: about how many titles were reviewed from ``first`` to ``last``, by the union of stored sketches.

    No review is read. Without any day there are none.
    """
    days = daily
    if first is not None:
        days = days.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.filter(F.col("date") <= F.lit(last).cast("date"))
    union = F.hll_sketch_estimate(F.hll_union_agg("titles"))
    return days.agg(F.coalesce(union, F.lit(0).cast("bigint")).alias("sketched"))


def kpi_display(overview: DataFrame) -> DataFrame:
    """The overview as shown: rounded numbers and formatted text."""
    return overview.select(
        thousands(F.col("total_reviews")).alias("total_reviews"),
        rounded(F.col("avg_rating"), 2).alias("avg_rating"),
        rounded(F.col("pos_pct"), 1).alias("pos_pct"),
        rounded(F.col("neg_pct"), 1).alias("neg_pct"),
        F.concat(fixed(F.col("pos_pct"), 0), F.lit("%")).alias("pos_text"),
        thousands(F.col("unique_products")).alias("unique_products"),
    )


def sentiment_mix(overview: DataFrame) -> DataFrame:
    """Positive, negative and the rest as rows; the rest includes unlabelled reviews."""
    rest = 100 - F.col("pos_pct") - F.col("neg_pct")
    return overview.select(
        F.stack(
            F.lit(3),
            F.lit("Positive"), F.col("pos_pct"),
            F.lit("Negative"), F.col("neg_pct"),
            F.lit("Neutral"), rest,
        ).alias("label", "pct")
    )


def price_brackets(reviews: DataFrame, edges: Sequence[float] = PRICE_EDGES) -> DataFrame:
    """Mean rating and review count per price bracket; reviews without a price are left out."""
    price = F.col("price")
    return (
        reviews.groupBy(
            bracket_order(price, edges).alias("bracket_no"), price_bracket(price, edges).alias("bracket")
        )
        .agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count"))
        .filter(F.col("bracket").isNotNull())
    )


def leaderboard(reviews: DataFrame, n: int = V.LEADERBOARD_ROWS, key: str = "review_id") -> DataFrame:
    """The ``n`` most reviewed titles with shares as fractions and the image of their first review.

    All buffers have a fixed size, hence a hash aggregate with map-side combine. It also finds the first
    review of each title by its ``key``, one unique whole number; the images are fetched afterwards by the
    ids of the ``n`` winners.
    """
    sentiment = F.col("sentiment")
    ranked = (
        reviews.filter(F.col("product_title").isNotNull())
        .groupBy("product_title")
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            F.avg("rating").alias("avg_rating"),
            share(sentiment, V.POSITIVE).alias("pos_pct"),
            share(sentiment, V.NEGATIVE).alias("neg_pct"),
            F.min(key).alias("_first"),
        )
        .orderBy(F.col("review_count").desc(), "product_title")
        .limit(n)
    )
    images = reviews.select(F.col(key).alias("_first"), "image_url")
    return (
        images.join(F.broadcast(ranked), "_first")  # at most n rows
        .drop("_first")
        .withColumn("neu_pct", 1 - F.col("pos_pct") - F.col("neg_pct"))
    )


def top_of(board: DataFrame, n: int = V.LEADERBOARD_SHOWN) -> DataFrame:
    return board.orderBy(F.col("review_count").desc(), "product_title").limit(n)


def first_images(reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """The image of each title's first review, null if that review has none.

    ``key`` is unique. Its minimum is found in a hash aggregate; the image is then fetched by it, one row per title.
    """
    first = reviews.groupBy("product_title").agg(F.min(key).alias("_first"))
    images = reviews.select(F.col(key).alias("_first"), "image_url")
    return first.join(images, "_first").drop("_first")


def chart_contexts(reviews: DataFrame, edges: Sequence[float] = PRICE_EDGES) -> DataFrame:
    """One row per dashboard chart with its data as text and the prompt made from it."""
    overview = kpi_overview(reviews).select(
        fixed(F.col("pos_pct"), 1).alias("pos"),
        fixed(F.col("neg_pct"), 1).alias("neg"),
        fixed(100 - F.col("pos_pct") - F.col("neg_pct"), 1).alias("neu"),
        thousands(F.col("total_reviews")).alias("total"),
    )
    fields = {c: F.col(c) for c in overview.columns}
    texts = overview.select(
        F.stack(
            F.lit(2),
            F.lit(V.TREND_CHART), render(V.TREND_CONTEXT, **fields),
            F.lit(V.MIX_CHART), render(V.MIX_CONTEXT, **fields),
        ).alias("chart", "context")
    )
    line = render(
        V.PRICE_LINE,
        bracket=F.col("bracket"),
        rating=fixed(F.col("avg_rating"), 2),
        total=thousands(F.col("review_count")),
    )
    # One row per bracket: the list is as long as ``edges``.
    lines = price_brackets(reviews, edges).agg(
        F.array_sort(F.collect_list(F.struct("bracket_no", line.alias("line")))).alias("lines")
    )
    joined = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    prices = lines.select(F.lit(V.PRICE_CHART).alias("chart"), render(V.PRICE_CONTEXT, rows=joined).alias("context"))
    return texts.unionByName(prices).withColumn(
        "prompt", render(V.CHART_PROMPT, chart=F.col("chart"), context=F.col("context"))
    ).withColumn("system", F.lit(V.CHART_SYSTEM))
