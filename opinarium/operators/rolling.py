"""Time-based rolling means without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLOCK_DAYS = 512


def rolling_mean(
    series: DataFrame,
    columns: Sequence[str],
    days: int,
    date: str = "date",
    group: Sequence[str] = (),
) -> DataFrame:
    """Mean of each column over the rows dated in ``(t - days, t]``; absent days do not count.

    A window ordered by date alone would run in one task. Dates are cut into blocks;
    a row also joins the next block when a window starting there can reach back to it,
    and those visiting rows are dropped after averaging. Each block is one partition.
    """
    reach = days - 1
    day = F.unix_date(F.col(date))
    home = F.floor(day / _BLOCK_DAYS)
    last = F.floor((day + reach) / _BLOCK_DAYS)
    blocked = (
        series.withColumn("_day", day)
        .withColumn("_home", home)
        .withColumn("_block", F.explode(F.sequence(home, last)))
    )
    frame = Window.partitionBy(*group, "_block").orderBy("_day").rangeBetween(-reach, 0)
    averaged = blocked.select(
        *group, date, "_home", "_block", *[F.avg(c).over(frame).alias(c) for c in columns]
    )
    return averaged.filter(F.col("_block") == F.col("_home")).drop("_home", "_block")
