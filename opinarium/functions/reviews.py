"""Review-level expressions: labels, shares, predicates and calendar parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinarium.fixed import NEGATIVE, NEUTRAL, POSITIVE


def sentiment_of(rating: Column) -> Column:
    """1-2 negative, 3 neutral, 4-5 positive; a missing rating has no label."""
    return F.when(rating <= 2, NEGATIVE).when(rating >= 4, POSITIVE).when(rating == 3, NEUTRAL)


def share(sentiment: Column, label: str) -> Column:
    """Fraction of rows with this label; unlabelled rows count in the denominator."""
    return F.avg(F.when(sentiment == label, 1.0).otherwise(0.0))


def matches(sentiment: Column, label: str) -> Column:
    return F.coalesce(sentiment == label, F.lit(False))


def has_image(image_url: Column) -> Column:
    return image_url.isNotNull() & (image_url != "")


def instant_of(epoch_ms: Column) -> Column:
    """UTC time of a Unix time in milliseconds, whatever the session's time zone."""
    seconds = (epoch_ms.cast("decimal(18, 0)") / 1000).cast("decimal(18, 6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def day_of(value: Column) -> Column:
    """Calendar day of a date, a timestamp or their text; unreadable text gives null."""
    return F.try_to_date(value.cast("string").substr(1, 10), "yyyy-MM-dd")


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def price_bracket(price: Column, edges: Sequence[float]) -> Column:
    """Label of the half-open bracket ``[low, high)``; the last bracket has no upper edge."""
    label = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, [*edges[1:], None]))):
        if high is None:
            label = F.when(price >= low, f"{low:g}+").otherwise(label)
        else:
            label = F.when((price >= low) & (price < high), f"{low:g}-{high:g}").otherwise(label)
    return label


def bracket_order(price: Column, edges: Sequence[float]) -> Column:
    position = F.lit(None).cast("int")
    for index, low in enumerate(edges):
        position = F.when(price >= low, index + 1).otherwise(position)
    return position
