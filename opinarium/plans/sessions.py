"""Conversation history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinarium.fixed import HISTORY_TURNS
from opinarium.operators.ranking import first_n_per_group


def last_turns(
    turns: DataFrame, n: int = HISTORY_TURNS, session: str = "session_id", order: Sequence[str] = ("turn",)
) -> DataFrame:
    """The last ``n`` turns of every session."""
    newest_first = [F.col(c).desc() for c in order]
    return first_n_per_group(turns, [session], newest_first, n, rank="_age").drop("_age")


def append_turns(
    history: DataFrame,
    new: DataFrame,
    n: int = HISTORY_TURNS,
    session: str = "session_id",
    order: Sequence[str] = ("turn",),
) -> DataFrame:
    """History with new turns added, cut to the last ``n`` per session."""
    return last_turns(history.unionByName(new), n, session, order)
