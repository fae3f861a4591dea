"""Cutting the lines of a text into sections without exploding or shuffling them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_sections(
    df: DataFrame, lines: str, kind_of: Callable[[Column], Column], output: str = "sections"
) -> DataFrame:
    """Add ``array<struct<kind, head, body array<string>>>``: each header line and the lines up to the next.

    ``kind_of`` names the kind of a header line and is null for other lines. Lines before
    the first header belong to no section. Headers are located first, so the work is
    linear in the number of lines and stays in the row.
    """
    marked = F.transform(
        F.col(lines), lambda line, i: F.struct(kind_of(line).alias("kind"), i.alias("at"))
    )
    located = df.withColumn("_heads", F.filter(marked, lambda mark: mark["kind"].isNotNull()))
    heads, all_lines = F.col("_heads"), F.col(lines)

    def section(head: Column, j: Column) -> Column:
        end = F.coalesce(F.get(heads, j + 1)["at"], F.size(all_lines))
        return F.struct(
            head["kind"].alias("kind"),
            F.get(all_lines, head["at"]).alias("head"),
            F.slice(all_lines, head["at"] + 2, end - head["at"] - 1).alias("body"),
        )

    return located.withColumn(output, F.transform(heads, section)).drop("_heads")


def section_lines(sections: Column, kind: str) -> Column:
    """All body lines, in order, of the sections of one kind."""
    chosen = F.filter(sections, lambda s: s["kind"] == kind)
    return F.flatten(F.transform(chosen, lambda s: s["body"]))
