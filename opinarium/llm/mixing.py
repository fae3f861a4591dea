"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's budget ends is found
from running totals and is the only one looked into at the next level, so no document is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinarium.llm.tables import written

LEVEL_BITS = 9
LEVELS = 7  # 63 bits in all
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words between ASCII blanks; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` for each source of ``sizes`` (``source, size``).

    Sources in code-point order, null last, get the weights in turn and share all sizes by them.
    A target ends at ``repeats`` times its source's size; what is above is shared again by weight.
    That fixed point is ``least(repeats * size, level * weight)``: with sources ordered by the level
    at which they fill up, the level left for the others rises as long as full ones are taken
    out and falls afterwards, so it is the maximum over one pass.
    """
    names = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = names.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    sources = sources.withColumn("_full", repeats * F.col("source_size"))
    before = W.orderBy(F.col("_full") / F.col("_weight"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    taken_out = F.coalesce(F.sum("_full").over(before), F.lit(0))
    weight_out = F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = sources.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - taken_out) / (F.sum("_weight").over(everything) - weight_out),
    )
    target = F.least(F.col("_full").cast("double"), F.max("_level").over(everything) * F.col("_weight"))
    return level.select("source", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("_rank", 63 - LEVEL_BITS * (level + 1))


def budget_thresholds(ranked: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, _threshold``: documents with a smaller ``_rank`` take up about the budget.

    ``ranked``: ``source, size, _rank`` (63-bit hash); ``budgets``: ``source, _budget``. Each level
    keeps the running total below the bucket where the budget ends and refines that bucket alone,
    until one rank is left; it is taken if this comes nearer to the budget.
    """
    state = written(
        budgets.select("source", "_budget", F.lit(0).cast("bigint").alias("_prefix"), F.lit(False).alias("_done")),
        "mixing-state",
    )
    for level in range(LEVELS):
        open_ = state.filter("NOT _done").select(F.col("source").alias("_source"), "_budget", "_prefix")
        within = (
            (F.col("_bucket_above") == F.col("_prefix")) if level else F.lit(True)
        )
        rows = ranked.withColumn("_bucket_above", _bucket(level - 1)) if level else ranked
        histogram = (
            rows.join(open_, F.col("source").eqNullSafe(F.col("_source")) & within)
            .groupBy("source", "_budget", _bucket(level).alias("_bucket"))
            .agg(
                F.sum("size").alias("_size"),
                F.min("_rank").alias("_low"),
                F.max("_rank").alias("_high"),
            )
        )
        running = W.partitionBy("source").orderBy("_bucket")
        ends = (
            histogram.withColumn("_upto", F.sum("_size").over(running.rowsBetween(W.unboundedPreceding, 0)))
            .filter(F.col("_upto") > F.col("_budget"))
            .withColumn("_first", F.row_number().over(running))
            .filter("_first = 1")
        )
        left = F.col("_budget") - (F.col("_upto") - F.col("_size"))
        single = F.col("_low") == F.col("_high")
        found = ends.select(
            F.col("source").alias("_source"),
            left.alias("_left"),
            F.when(single, F.when(2 * left >= F.col("_size"), F.col("_low") + 1).otherwise(F.col("_low")))
            .otherwise(F.col("_bucket"))
            .alias("_next"),
            single.alias("_single"),
        )
        # An open source whose whole bucket fits takes all of it.
        above = F.shiftleft(F.col("_prefix") + 1, 63 - LEVEL_BITS * level) if level else F.lit(2**63 - 1)
        state = written(
            state.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source",
                F.when(F.col("_done"), F.col("_budget")).otherwise(F.coalesce("_left", "_budget")).alias("_budget"),
                F.when(F.col("_done"), F.col("_prefix"))
                .otherwise(F.coalesce(F.col("_next"), above))
                .alias("_prefix"),
                (F.col("_done") | F.coalesce(F.col("_single"), F.lit(True))).alias("_done"),
            ),
            "mixing-state",
        )
        if state.filter("NOT _done").isEmpty():
            break
    return state.select("source", F.col("_prefix").alias("_threshold"))


def _rank() -> Column:
    """63 bits of a hash of key, source and text."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "source", "text"), 1)


def mix_plan(docs: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and ranks of all documents, and what each source takes of its own: ``_whole, _threshold``.

    A target of ``k`` times its source and a part takes every document ``k`` times, and once more
    those whose rank lies below the threshold of that part.
    """
    sized = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _rank().alias("_rank")),
        "mixing-sizes",
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = written(source_targets(sized, weights, repeats).withColumn("_whole", whole), "mixing-targets")
    budgets = targets.select("source", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_budget"))
    thresholds = budget_thresholds(sized.select("source", "size", "_rank"), budgets)
    thresholds = thresholds.withColumnRenamed("source", "_other")
    per_source = targets.join(thresholds, F.col("source").eqNullSafe(F.col("_other"))).select(
        F.col("source").alias("_source"), "source_size", "target", "_whole", "_threshold"
    )
    return sized, written(per_source, "mixing-plan")


def _copies(rank: Column, repeats: int) -> Column:
    return F.least(F.col("_whole") + (rank < F.col("_threshold")).cast("bigint"), F.lit(repeats)).cast("int")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies``: how often the mix takes each document.

    The rank covers id, source and text; rows that repeat all three are taken alike, however many.
    Null text has size 0, a null source is a source of its own. No rows in, no rows out.
    """
    sized, per_source = mix_plan(docs, weights, repeats)
    return sized.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source", "source_size", "target", _copies(F.col("_rank"), repeats).alias("copies")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the whole rows of ``docs``, each as often as the mix takes it."""
    _, per_source = mix_plan(docs, weights, repeats)
    rows = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_own"), _rank().alias("_rank"))
    return (
        rows.join(per_source, F.col("_own").eqNullSafe(F.col("_source")))
        .select("_row", F.explode(F.array_repeat(F.lit(0), _copies(F.col("_rank"), repeats))).alias("_copy"))
        .select("_row.*")
    )
