"""Filters that depend on a plan carried by each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.fixed import NEGATIVE, POSITIVE

from opinarium.operators.hints import hint_pattern, pattern_matches


def sentiment_allowed(sentiment: Column, wanted: Column) -> Column:
    """True unless the plan asks for positive or negative and the row differs."""
    asked = F.coalesce(wanted.isin(POSITIVE, NEGATIVE), F.lit(False))
    return F.when(asked, F.coalesce(sentiment == wanted, F.lit(False))).otherwise(True)


def title_matches(title: Column, hint: Column, mode: str = "regex") -> Column:
    """Case-insensitive match of a hint inside a title; a missing title never matches.

    ``mode="regex"`` reads the hint as a regular expression if it is sure to be well formed (see ``hints``); any other
    hint, like ``c++(``, is plain text, so that one bad hint does not stop the others. ``"literal"`` reads all as plain text.
    """
    return pattern_matches(title, hint, title_pattern(hint, mode))


def title_pattern(hint: Column, mode: str = "regex") -> Column:
    """What ``title_matches`` makes of a hint, for a table in which many titles meet one hint."""
    if mode not in ("regex", "literal"):
        raise ValueError(f"unknown mode {mode!r}")
    return hint_pattern(hint) if mode == "regex" else F.lit(None).cast("string")


def soft_filter(df: DataFrame, flag: Column, active: Column, min_matches: int, group: Sequence[str]) -> DataFrame:
    """Keep flagged rows where a group has at least ``min_matches`` of them, else all its rows.

    ``active`` switches the filter off for groups without a hint. Groups are candidate
    lists, already cut to a fixed number of rows.
    """
    counted = df.withColumn("_flag", flag & active).withColumn(
        "_matches", F.count_if("_flag").over(Window.partitionBy(*group))
    )
    keep = F.col("_flag") | (F.col("_matches") < min_matches)
    return counted.filter(keep).drop("_flag", "_matches")


def given(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))
