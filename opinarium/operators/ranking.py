"""First-n selection that never gathers a hot group, or a whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lanes of a group that is cut before it is brought together by some of its columns only.
LANES = 16
_BUCKETS = 4096


def first_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    lanes: int = 1,
    cluster_by: Sequence[str] = (),
) -> DataFrame:
    """The first ``n`` rows of every group in a total order, numbered from 1.

    Spark cuts each map task to ``n`` rows per group before the one shuffle (``WindowGroupLimit``), so a
    group reaches its reducer with ``n`` rows per map task. For large ``n``, more ``lanes`` add a shuffle
    in which a group is spread by map task and cut to ``n`` per lane. ``cluster_by``, some of the group columns, brings together rows
    that a later step needs side by side, so that it needs no exchange of its own.
    """
    if lanes > 1:
        df = df.withColumn("_lane", F.spark_partition_id() % lanes)
        by_lane = Window.partitionBy(*group, "_lane").orderBy(*order)
        df = df.withColumn("_place", F.row_number().over(by_lane)).filter(F.col("_place") <= n)
        df = df.drop("_place", "_lane")
    if cluster_by:
        df = df.repartition(*cluster_by)
    by_group = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by_group)).filter(F.col(rank) <= n)


def key_cutoff(
    df: DataFrame, key: str, n: int, surplus: int = 0, bounds: tuple[int, int] | None = None
) -> int | None:
    """A bound ``c`` such that at least ``n`` and at most ``n + surplus`` rows have ``key <= c``.

    The bound is narrowed by counting rows in at most 4,096 equal key ranges per pass,
    so only counts reach the driver, and later passes read less. ``bounds`` saves the
    pass that finds the smallest and largest key. Rows that repeat the n-th smallest key
    come on top of ``surplus``. None means the table has no more than ``n`` rows.
    ``key`` must be a whole number; rows without one are not counted.
    """
    low, high = bounds or df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return None
    below, part = 0, df.filter(F.col(key).isNotNull())
    while True:
        width = max(1, -(-(high - low + 1) // _BUCKETS))
        # In decimals: keys may span the whole range of bigint.
        bucket_no = F.expr(f"CAST((CAST(`{key}` AS DECIMAL(20, 0)) - {low}BD) div {width}BD AS INT)").alias("bucket")
        counts = part.groupBy(bucket_no).count().collect()
        passed = below
        for bucket, count in sorted((r["bucket"], r["count"]) for r in counts):
            if passed + count >= n:
                break
            passed += count
        else:
            return None
        end = min(high, low + (bucket + 1) * width - 1)
        if width == 1 or passed + count - n <= surplus:
            return end
        below, low, high = passed, low + bucket * width, end
        part = df.filter(F.col(key).between(low, high))


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the ``n`` smallest values of a unique whole-number key; rows without one are left out.

    ``orderBy(key).limit(n)`` sends ``n`` rows of every input partition to one task,
    which for a large ``n`` is most of the table. A cutoff on the key is a plain
    filter instead: no sort, no exchange, and it reaches the Parquet scan.
    """
    cutoff = key_cutoff(df, key, n)
    return df.filter(F.col(key).isNotNull() if cutoff is None else F.col(key) <= cutoff)


def hash_sample(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """A reproducible sample: the ``n`` rows with the smallest hash of their key.

    The hash is the first 60 bits of an MD5, which other engines can compute too. The
    sample itself is ordered in one task; it is meant for display.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    hashed = df.withColumn("_hash", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))
    # Hashes are even: the n smallest lie below their share of the range, with a wide margin.
    cutoff = int(2**60 * min(1.0, (n + 8 * n**0.5 + 100) / max(1, df.count())))
    if hashed.filter(F.col("_hash") <= cutoff).limit(n).count() < n:
        cutoff = key_cutoff(hashed, "_hash", n, surplus=max(1_000, n // 10), bounds=(0, 2**60 - 1))
    kept = hashed if cutoff is None else hashed.filter(F.col("_hash") <= cutoff)
    return kept.orderBy("_hash", *key).limit(n).drop("_hash")
