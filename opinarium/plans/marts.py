"""The stored aggregates a dashboard reads instead of the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from opinarium import fixed as V
from opinarium.operators.ranking import hash_sample
from opinarium.plans.metrics import PRICE_EDGES, leaderboard, price_brackets
from opinarium.plans.series import daily_sentiment
from opinarium.sources.writers import write_parquet

MARTS = ("daily", "brackets", "top_products", "sample")


def build_marts(
    reviews: DataFrame,
    path: str,
    edges: Sequence[float] = PRICE_EDGES,
    key: str = "review_id",
    sample: int = V.DISPLAY_SAMPLE,
    names: Sequence[str] = MARTS,
) -> dict[str, DataFrame]:
    """Write the named tables below ``path`` and return them as stored."""
    jobs = {
        "daily": lambda: daily_sentiment(reviews),
        "brackets": lambda: price_brackets(reviews, edges),
        "top_products": lambda: leaderboard(reviews, key=key),
        "sample": lambda: hash_sample(reviews, [key], sample),
    }
    return {name: write_parquet(jobs[name](), f"{path}/{name}") for name in names}


def read_marts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in MARTS}
