"""From raw reviews and product metadata to the cleaned corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions.language import detect
from opinarium.functions.reviews import instant_of, sentiment_of
from opinarium.functions.text import strip
from opinarium.operators.ranking import first_n
from opinarium.session import fresh_path
from opinarium.sources.writers import write_parquet

DEDUPE_KEY = ("user_id", "parent_asin", "text")
MIN_CHARS = 20


def first_rows(raw: DataFrame, n: int, key: str = "review_id") -> DataFrame:
    """The first ``n`` rows of the source in key order; rows without a key are left out."""
    return first_n(raw, key, n)


def needed_products(products: DataFrame, reviews: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Metadata of products that occur in the reviews.

    Distinct keys are formed map-side first, so a product with a third of all reviews
    reaches the join as one row, and the distinct's partitioning serves the join.
    """
    return products.join(reviews.select(key).distinct(), key, "left_semi")


def with_metadata(reviews: DataFrame, products: DataFrame, key: str = "parent_asin", how: str = "inner") -> DataFrame:
    """Reviews with their product's columns. ``products`` has one row per key.

    No hint is given: a small metadata table is broadcast by its size, a large one is
    sort-merged and AQE splits the partition of a product with very many reviews.
    """
    return reviews.join(products, key, how)


def content_digest(columns: Sequence[str]) -> Column:
    """128 bits of a row's values, as hexadecimal text; every value is written with its length and a null by a mark of its own."""

    def written(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.md5(F.concat(*[written(c) for c in columns]))


def _id_of(digest: Column) -> Column:
    """A negative id from the first 60 bits, so that made ids meet no given one that counts from zero."""
    return -F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") - 1


def with_ids(raw: DataFrame, id_column: str = "review_id") -> DataFrame:
    """Every row with an id; one that has none gets one from a digest of all its columns, nulls included.

    Rows without ids that repeat in every column are the same review, and one of them stays; columns, not digests, are
    compared before anything is dropped. Different rows that share an id by chance are told apart by the rest of their digests
    and get ids of their own. Only rows with an id that repeats are moved, repeats of a map task as one.
    """
    columns = sorted(c for c in raw.columns if c != id_column)
    given = F.col(id_column) if id_column in raw.columns else F.lit(None).cast("bigint")
    tagged = raw.withColumn("_digest", F.when(given.isNull(), content_digest(columns)))
    tagged = tagged.withColumn(id_column, F.coalesce(given, _id_of(F.col("_digest"))))
    counts = tagged.filter("_digest IS NOT NULL").groupBy(F.col(id_column).alias("_repeated")).count()
    repeated = write_parquet(counts.filter("count > 1").drop("count"), fresh_path(raw.sparkSession, "repeated-ids"))
    if repeated.isEmpty():
        return tagged.drop("_digest")
    same = (F.col(id_column) == F.col("_repeated")) & F.col("_digest").isNotNull()
    distinct = tagged.join(repeated, same, "left_semi").dropDuplicates([*columns, id_column, "_digest"])
    nth = F.row_number().over(Window.partitionBy(id_column).orderBy("_digest", *columns))
    again = F.md5(F.concat_ws("#", "_digest", nth.cast("string")))
    apart = distinct.withColumn(id_column, F.when(nth == 1, F.col(id_column)).otherwise(_id_of(again)))
    return tagged.join(repeated, same, "left_anti").unionByName(apart).drop("_digest")


def dedupe(df: DataFrame, key: Sequence[str] = DEDUPE_KEY, id_column: str = "review_id") -> DataFrame:
    """Of every set of copies the row with the smallest id. ``id_column`` is unique; rows without an id stay.

    Copies are found on digests: keys that occur once leave in a hash aggregate, and only ids of rows to be
    dropped, which are few, meet the table again. Texts are neither sorted nor used as a shuffle key,
    and stay in place where the ids can be broadcast.
    """
    types = dict(df.dtypes)
    narrow = df.select(
        *[(F.sha2(c, 256) if types[c] == "string" else F.col(c)).alias(f"_key{i}") for i, c in enumerate(key)],
        F.col(id_column).alias("_id"),
    )
    names = [f"_key{i}" for i in range(len(key))]
    copied = (
        narrow.groupBy(*names)
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .select(*[F.col(n).alias(f"{n}_of") for n in names], "_first")
    )
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names])
    dropped = narrow.join(copied, same & (F.col("_id") > F.col("_first"))).select("_id")
    return df.join(dropped, F.col(id_column) == F.col("_id"), "left_anti")


def with_instant(df: DataFrame, epoch_ms: str = "ts_ms") -> DataFrame:
    return df.withColumn("review_ts", instant_of(F.col(epoch_ms))).withColumn(
        "review_date", F.to_date("review_ts")
    )


def drop_short(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Reviews whose stripped text has at least ``min_chars`` characters."""
    return df.filter(F.char_length(strip(F.col("text"))) >= min_chars)


def english_only(df: DataFrame, lang: str = "lang") -> DataFrame:
    return df.filter(F.col(lang) == "en")


def with_sentiment(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment", sentiment_of(F.col("rating")))


def with_language(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A language for every row: the label if there is one, else the detector's vote."""
    label = F.col(lang) if lang in df.columns else F.lit(None).cast("string")
    unlabelled = df.withColumn("_unlabelled", F.when(label.isNull(), F.col(text)))
    detected = detect(unlabelled, "_unlabelled", "_detected")
    return detected.withColumn(lang, F.coalesce(label, F.col("_detected"))).drop("_detected", "_unlabelled")


def clean_reviews(raw: DataFrame, products: DataFrame, n: int | None = None) -> DataFrame:
    """The whole chain: ids, drop short, dedupe, English, metadata, time, sentiment.

    ``n`` takes the first ``n`` rows by id beforehand; all rows are cleaned without it. Short texts go before the dedupe: copies
    share their text, so this cannot change which copy survives. The language may differ between labelled
    copies and is applied afterwards. An inner join with the metadata keeps needed products only.
    """
    known = with_ids(raw)
    taken = known if n is None else first_rows(known, n)
    unique = dedupe(drop_short(taken))
    return with_sentiment(with_instant(with_metadata(english_only(with_language(unique)), products)))
