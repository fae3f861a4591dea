"""Per-product results, for all products at once instead of one per click."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium import fixed as V
from opinarium.functions.reviews import day_text, has_image, matches, share
from opinarium.functions.text import clip, clip_marked
from opinarium.operators.ranking import LANES, first_n_per_group
from opinarium.plans.metrics import first_images
from opinarium.plans.series import monthly_totals

KEY = ("review_id",)


def product_stats(reviews: DataFrame) -> DataFrame:
    """Review count, mean rating, positive and negative share in percent for every title."""
    sentiment = F.col("sentiment")
    return (
        reviews.filter(F.col("product_title").isNotNull())
        .groupBy("product_title")
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            F.avg("rating").alias("avg_rating"),
            (share(sentiment, V.POSITIVE) * 100).alias("pos_pct"),
            (share(sentiment, V.NEGATIVE) * 100).alias("neg_pct"),
        )
    )


def stats_of(board: DataFrame, reviews: DataFrame) -> DataFrame:
    """Statistics of the titles on a leaderboard only."""
    chosen = board.select("product_title")
    return product_stats(reviews.join(chosen, "product_title", "left_semi"))


def first_by_sentiment(reviews: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """The first ``n`` positive and ``n`` negative reviews of every title."""
    two_sided = reviews.filter(
        F.col("product_title").isNotNull() & F.col("sentiment").isin(V.POSITIVE, V.NEGATIVE)
    )
    group = ["product_title", "sentiment"]
    return first_n_per_group(two_sided, group, [F.col(c) for c in key], n, lanes=LANES, cluster_by=["product_title"])


def product_top(reviews: DataFrame, n: int = V.PRODUCT_SHOWN, key: Sequence[str] = KEY) -> DataFrame:
    return first_by_sentiment(reviews, n, key)


def product_samples(
    reviews: DataFrame,
    n: int = V.PRODUCT_SAMPLES,
    min_side: int = V.MIN_PER_SIDE,
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Samples for a summary, for titles with at least ``min_side`` reviews on both sides.

    The sides are counted on the samples themselves, at most ``2 n`` rows per title.
    """
    samples = first_by_sentiment(reviews, n, key)
    return both_sides(samples, ["product_title"], min_side)


def both_sides(samples: DataFrame, group: Sequence[str], min_side: int) -> DataFrame:
    """Groups with at least ``min_side`` positive and ``min_side`` negative rows.

    Meant for lists already cut to a fixed length, which the window then holds.
    """
    whole = Window.partitionBy(*group)
    pos = F.count_if(matches(F.col("sentiment"), V.POSITIVE)).over(whole)
    neg = F.count_if(matches(F.col("sentiment"), V.NEGATIVE)).over(whole)
    counted = samples.withColumn("_pos", pos).withColumn("_neg", neg)
    return counted.filter((F.col("_pos") >= min_side) & (F.col("_neg") >= min_side)).drop("_pos", "_neg")


def product_images(reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """The first review's image of every title and whether it can be shown."""
    titled = reviews.filter(F.col("product_title").isNotNull())
    return first_images(titled, key).withColumn(
        "has_image", F.coalesce(has_image(F.col("image_url")), F.lit(False))
    )


def product_labels(reviews: DataFrame) -> DataFrame:
    """Every title with its short forms for source cards, pickers and leaderboard rows."""
    title = F.col("product_title")
    return (
        reviews.filter(title.isNotNull())
        .select(title)
        .distinct()
        .select(
            title,
            clip(title, V.SOURCE_LABEL_CHARS).alias("source_label"),
            clip(title, V.PICKER_LABEL_CHARS).alias("picker_label"),
            clip(title, V.ROW_LABEL_CHARS).alias("row_label"),
        )
    )


def review_cards(reviews: DataFrame, date: str = "review_date") -> DataFrame:
    """Reviews as shown in a product's details: day and shortened text."""
    return reviews.select(
        "review_id",
        "rating",
        day_text(F.col(date)).alias("day"),
        clip_marked(F.col("text"), V.CARD_CHARS, V.CARD_MARK).alias("body"),
    )


def source_previews(reviews: DataFrame) -> DataFrame:
    """Reviews as shown below an answer: short title, preview and full text."""
    return reviews.select(
        "review_id",
        clip(F.col("product_title"), V.SOURCE_LABEL_CHARS).alias("source_label"),
        "rating",
        clip_marked(F.col("text"), V.PREVIEW_CHARS, V.PREVIEW_MARK).alias("preview"),
        "text",
    )


def product_drilldown(reviews: DataFrame, key: Sequence[str] = KEY, text: Sequence[str] = ("text",)) -> DataFrame:
    """One row per title: statistics, image, monthly series, displayed reviews, summary flag.

    Statistics and series come from one pass over monthly totals. Every part has one
    row per title before the joins, which reuse the partitioning by title. The first column of ``key`` is unique. Arrays hold
    at most ``PRODUCT_SHOWN`` reviews per side and one entry per month.
    """
    titled = reviews.filter(F.col("product_title").isNotNull())
    monthly = monthly_totals(titled).withColumn(
        "_shown", F.when(F.col("month").isNotNull() & (F.col("pos") + F.col("neu") + F.col("neg") > 0), True)
    )
    total = F.sum("rows")
    figures = monthly.groupBy("product_title").agg(
        total.alias("review_count"),
        F.try_divide(F.sum("stars"), F.sum("rated")).alias("avg_rating"),
        (F.sum("pos") / total * 100).alias("pos_pct"),
        (F.sum("neg") / total * 100).alias("neg_pct"),
        F.when(
            total >= V.SERIES_MIN_REVIEWS,
            F.array_sort(F.collect_list(F.when(F.col("_shown"), F.struct("month", *V.SENTIMENTS)))),
        )
        .otherwise(F.array())
        .alias("months"),
    )
    needed = max(V.PRODUCT_SHOWN, V.MIN_PER_SIDE)
    samples = first_by_sentiment(titled.select("product_title", "sentiment", *key, *text), needed, key)
    shown = F.struct("rank", *key, *text)

    def side(label: str, name: str) -> Column:
        of_side = (F.col("sentiment") == label) & (F.col("rank") <= V.PRODUCT_SHOWN)
        return F.array_sort(F.collect_list(F.when(of_side, shown))).alias(name)

    sides = samples.groupBy("product_title").agg(
        side(V.POSITIVE, "top_pos"),
        side(V.NEGATIVE, "top_neg"),
        F.count_if(F.col("sentiment") == V.POSITIVE).alias("_pos"),
        F.count_if(F.col("sentiment") == V.NEGATIVE).alias("_neg"),
    )
    enough = (F.col("_pos") >= V.MIN_PER_SIDE) & (F.col("_neg") >= V.MIN_PER_SIDE)
    return (
        figures.join(product_images(titled, key[0]), "product_title", "left")
        .join(sides, "product_title", "left")
        .withColumn("has_summary", F.coalesce(enough, F.lit(False)))
        .drop("_pos", "_neg")
    )
