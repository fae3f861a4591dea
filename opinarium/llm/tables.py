"""Helpers shared by the operators: written intermediate tables, samples, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.session import fresh_path

#: Setting under which Spark removes the shuffle files of a finished job.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with more than one in so many of all rows is hot; there are fewer such keys than this.
HOT_SHARE = 1024
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives executors.

    What was shuffled for it is not needed again, so its files are removed as soon as the table is there.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``key``, the same on every run.

    Only keys are compared; the chosen ones are fetched through a broadcast of ``n`` keys.
    Rows with a null key are never chosen, repeated keys come together.
    """
    keys = df.select(F.col(key).alias("_chosen")).dropna().distinct()
    chosen = keys.orderBy(F.xxhash64("_chosen"), "_chosen").limit(n)
    return df.join(F.broadcast(chosen), F.col(key) == F.col("_chosen"), "left_semi")


def hot_join(rows: DataFrame, side: DataFrame, key: str, weight: str, share: int = HOT_SHARE) -> DataFrame:
    """``rows`` left-joined with ``side``, which has one row per key and in ``weight`` how many rows have it.

    Fewer than ``share`` keys can hold more than that part of the weight: these are broadcast, so that their
    rows stay where they are, and the others joined by key. Rows without a key take no part in the exchange. Both tables are read
    more than once and should be stored.
    """
    total = side.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = side.filter(F.col(weight) * share > total)
    rest = side.filter(F.col(weight) * share <= total)
    keyed = rows.filter(F.col(key).isNotNull())
    others = keyed.join(F.broadcast(hot.select(key)), key, "left_anti")
    return (
        keyed.join(F.broadcast(hot), key)
        .unionByName(others.join(rest, key, "left"))
        .unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
    )


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, as UTF-8."""
    return (text or "").encode().split()


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that few texts stand in Python at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows_with_text(docs: DataFrame, carried: Column) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array]]:
    """``_row``, a struct to be carried along, with the text beside it, and how to find the text in a batch.

    A struct that has the text itself is not sent with a second copy of it.
    """
    source = docs.select(carried.alias("_row"), F.col("text").alias("_text"))
    if "text" in source.schema["_row"].dataType.names:
        return source.select("_row"), lambda batch: batch.column(0).field("text")
    return source, lambda batch: batch.column(1)


def arrow_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch as Python tuples of the named columns."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))
