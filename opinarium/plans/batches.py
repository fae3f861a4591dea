"""Cleaning and aggregating reviews that arrive in batches, without going over earlier ones again.

Every batch has a name and adds partitions of its own to the stored tables; a batch that is run again, after a lost job say, writes the
same partitions once more and counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium import fixed as V
from opinarium.functions.reviews import bracket_order, price_bracket
from opinarium.operators.bits import bit_words, merged_words, with_likely
from opinarium.plans.ingest import DEDUPE_KEY, dedupe
from opinarium.plans.metrics import PRICE_EDGES
from opinarium.session import fresh_path
from opinarium.sources.writers import write_parquet

_SEEN = "digest string, hash bigint, batch string"
_WORDS = "word bigint, bits bigint, batch string"
_TITLES = (
    "month string, date date, product_title string, reviews bigint, rated bigint, rating_sum bigint, pos bigint, neu bigint, neg bigint, "
    "first_id bigint, batch string"
)
_BRACKETS = "bracket_no int, bracket string, reviews bigint, rated bigint, rating_sum bigint, batch string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batches, empty before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _write(table: DataFrame, path: str, batch: str, *partitions: str) -> None:
    """The partitions of one batch, in place of those it wrote before."""
    table.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={batch}")


# --- copies -----------------------------------------------------------------------


def _digest(key: Sequence[str]) -> Column:
    fields = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in key]
    return F.sha2(F.concat(*fields), 256)


def dedupe_batch(
    batch: DataFrame, store: str, name: str, key: Sequence[str] = DEDUPE_KEY, id_column: str = "review_id"
) -> DataFrame:
    """The rows of a batch that copy none in it or in an earlier batch; stored, as are their digests.

    ``store`` keeps a digest of every key that was kept, and for each batch the bits of these. A row whose bits are not
    all set is new and stays where it is; only likely repeats meet the stored digests. Of copies within the batch the smallest
    id stays, of others the earlier batch's, so that batches of rising ids give what one batch of all would. Rows without an
    id stay, and their keys are not stored.
    """
    spark = batch.sparkSession
    earlier = F.col("batch") != name
    seen = _stored(spark, f"{store}/seen", _SEEN).filter(earlier)
    words = merged_words(_stored(spark, f"{store}/words", _WORDS).filter(earlier))
    unique = dedupe(batch, key, id_column).withColumn("_digest", F.when(F.col(id_column).isNotNull(), _digest(key)))
    unique = unique.withColumn("_hash", F.xxhash64("_digest"))
    tested = with_likely(unique, F.col("_hash"), words, "_likely").withColumn("_likely", F.col("_likely") & F.col("_digest").isNotNull())
    asked = tested.filter("_likely").select("_digest", "_hash")
    repeats = write_parquet(
        asked.join(seen, (F.col("_hash") == F.col("hash")) & (F.col("_digest") == F.col("digest")), "left_semi").select(F.col("_digest").alias("_seen")),
        fresh_path(spark, "repeats"),
    )
    fresh = tested.filter("_likely").join(repeats, F.col("_digest") == F.col("_seen"), "left_anti")
    kept = write_parquet(
        tested.filter("NOT _likely").unionByName(fresh).drop("_likely"), fresh_path(spark, "kept-batch")
    )
    new = kept.filter("_digest IS NOT NULL")
    _write(new.select(F.col("_digest").alias("digest"), F.col("_hash").alias("hash")), f"{store}/seen", name)
    _write(bit_words(new, "_hash"), f"{store}/words", name)
    return kept.drop("_digest", "_hash")


# --- aggregates ---------------------------------------------------------------------


def _sums(key: str | None = None) -> list[Column]:
    """States that merge by addition, and by the minimum for the first id."""
    sentiments = [F.count_if(F.col("sentiment") == s).alias(n) for s, n in zip(V.SENTIMENTS, V.SENTIMENTS)]
    first = [F.min(key).alias("first_id")] if key else []
    return [
        F.count(F.lit(1)).alias("reviews"), F.count("rating").alias("rated"),
        F.coalesce(F.sum("rating").cast("bigint"), F.lit(0).cast("bigint")).alias("rating_sum"), *(sentiments if key else []), *first,
    ]


def _month(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def add_batch(reviews: DataFrame, path: str, name: str, edges: Sequence[float] = PRICE_EDGES, key: str = "review_id") -> None:
    """Add a batch's partial states: by day and title, and by price bracket.

    Each is a small table next to the reviews. Days come back late as they like: a day's states are spread over the batches that had
    some of it, in a partition per batch and month.
    """
    dated = reviews.groupBy(F.col("review_date").alias("date"), "product_title").agg(*_sums(key))
    _write(dated.withColumn("month", _month(F.col("date"))), f"{path}/states/titles", name, "month")
    price = F.col("price")
    priced = reviews.groupBy(bracket_order(price, edges).alias("bracket_no"), price_bracket(price, edges).alias("bracket")).agg(*_sums())
    _write(priced.filter("bracket IS NOT NULL"), f"{path}/states/brackets", name)


def _titles(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/states/titles", _TITLES)


def touched_months(spark: SparkSession, path: str, names: Sequence[str]) -> list[str]:
    """Months that the named batches have reviews of."""
    found = _titles(spark, path).filter(F.col("batch").isin(list(names))).select("month").distinct()
    return sorted(r["month"] for r in found.collect())  # one value per month


def refresh_daily(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The daily sentiment mart, rewritten for the given months only, or for all; other months' files stay as they are."""
    states = _titles(spark, path).filter("date IS NOT NULL")
    if months is not None:
        states = states.filter(F.col("month").isin(list(months)))
    daily = states.groupBy("month", "date").agg(*[F.sum(s).alias(s) for s in V.SENTIMENTS])
    mode = {"partitionOverwriteMode": "dynamic"}
    daily.write.mode("overwrite").options(**mode).partitionBy("month").parquet(f"{path}/daily")
    return spark.read.schema("date date, pos bigint, neu bigint, neg bigint, month string").parquet(f"{path}/daily").drop("month")


def merged_brackets(spark: SparkSession, path: str) -> DataFrame:
    """What ``price_brackets`` makes of all batches."""
    merged = _stored(spark, f"{path}/states/brackets", _BRACKETS).groupBy("bracket_no", "bracket").agg(
        *[F.sum(c).alias(c) for c in ("reviews", "rated", "rating_sum")]
    )
    mean = F.when(F.col("rated") > 0, F.col("rating_sum") / F.col("rated"))
    return merged.select("bracket_no", "bracket", mean.alias("avg_rating"), F.col("reviews").alias("review_count"))


def merged_leaderboard(
    spark: SparkSession, path: str, reviews: DataFrame, n: int = V.LEADERBOARD_ROWS, key: str = "review_id"
) -> DataFrame:
    """What ``leaderboard`` makes of all batches; ``reviews`` are read for the images of the ``n`` winners only."""
    ranked = (
        _titles(spark, path).filter("product_title IS NOT NULL").groupBy("product_title")
        .agg(*[F.sum(c).alias(c) for c in ("reviews", "rated", "rating_sum", "pos", "neg")], F.min("first_id").alias("_first"))
        .orderBy(F.col("reviews").desc(), "product_title")
        .limit(n)
    )
    pos, neg = (F.col(c) / F.col("reviews") for c in ("pos", "neg"))
    board = ranked.select(
        "product_title", F.col("reviews").alias("review_count"),
        F.when(F.col("rated") > 0, F.col("rating_sum") / F.col("rated")).alias("avg_rating"),
        pos.alias("pos_pct"), neg.alias("neg_pct"), (1 - pos - neg).alias("neu_pct"), "_first",
    )
    images = reviews.select(F.col(key).alias("_first"), "image_url")
    return images.join(F.broadcast(board), "_first").drop("_first")  # at most n rows


def merge_batches(spark: SparkSession, path: str, into: str, name: str) -> None:
    """The states of all batches as those of one, ``name``, at a new path, so that reading them does not slow down with their number."""
    sums = [F.sum(c).alias(c) for c in ("reviews", "rated", "rating_sum")]
    counts = [F.sum(c).alias(c) for c in V.SENTIMENTS]
    titles = _titles(spark, path).groupBy("month", "date", "product_title").agg(*sums, *counts, F.min("first_id").alias("first_id"))
    _write(titles, f"{into}/states/titles", name, "month")
    brackets = _stored(spark, f"{path}/states/brackets", _BRACKETS).groupBy("bracket_no", "bracket").agg(*sums)
    _write(brackets, f"{into}/states/brackets", name)
