"""Assembling the text handed to a language model; the model itself stays outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium import fixed as V
from opinarium.functions.text import clip, render
from opinarium.operators.ranking import first_n_per_group
from opinarium.plans.products import product_samples


def joined_lines(rank: Column, line: Column, separator: str = "\n") -> Column:
    """Aggregate lines in rank order. Groups are cut to a fixed number of rows beforehand."""
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), line.alias("line"))))
    return F.array_join(F.transform(ordered, lambda r: r["line"]), separator)


def rating_text(rating: Column) -> Column:
    return F.coalesce(rating.cast("string"), F.lit("nan"))


def rewrite_prompts(questions: DataFrame, topics: bool = False) -> DataFrame:
    """The prompt that asks for a query plan; a topic is first put as a question."""
    question = F.col("question")
    if topics:
        question = render(V.TOPIC_QUESTION, topic=question)
    return questions.select(
        "question_id",
        render(V.REWRITE_PROMPT, question=question).alias("prompt"),
        F.lit(V.REWRITE_SYSTEM).alias("system"),
    )


def context_lines(hits: DataFrame) -> DataFrame:
    """Each hit as a numbered line of context."""
    line = render(
        V.CONTEXT_LINE,
        number=F.col("number"),
        product=F.col("product_title"),
        rating=rating_text(F.col("rating")),
        sentiment=F.col("sentiment"),
        text=clip(F.col("text"), V.CONTEXT_CHARS),
    )
    return hits.select("question_id", "number", line.alias("line"))


def answer_contexts(hits: DataFrame) -> DataFrame:
    """One context per question that has hits."""
    text = joined_lines(F.col("number"), F.col("line"), V.CONTEXT_SEPARATOR)
    return context_lines(hits).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_hits"), text.alias("context")
    )


def answer_prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: its prompt, or the fixed answer where nothing was found."""
    found = questions.select("question_id", "question").join(answer_contexts(hits), "question_id", "left")
    prompt = render(V.ANSWER_PROMPT, question=F.col("question"), context=F.col("context"))
    return found.select(
        "question_id",
        F.coalesce("n_hits", F.lit(0).cast("bigint")).alias("n_hits"),
        F.when(F.col("n_hits").isNotNull(), prompt).alias("prompt"),
        F.when(F.col("n_hits").isNull(), F.lit(V.NOTHING_FOUND)).alias("answer"),
        F.when(F.col("n_hits").isNotNull(), F.lit(V.ANSWER_SYSTEM)).alias("system"),
    )


def pros_cons_prompts(samples: DataFrame, group: str, topic: Column, rank: str) -> DataFrame:
    """One prompt per topic or product from its positive and negative samples."""
    line = render(V.TOPIC_LINE, text=clip(F.col("text"), V.TOPIC_CHARS))
    # Each block is aggregated per group and sentiment first, then set side by side.
    blocks = samples.groupBy(group, "sentiment").agg(
        F.first(topic).alias("topic"), joined_lines(F.col(rank), line).alias("block")
    )
    sides = blocks.groupBy(group).agg(
        F.first("topic").alias("topic"),
        F.max(F.when(F.col("sentiment") == V.POSITIVE, F.col("block"))).alias("positive"),
        F.max(F.when(F.col("sentiment") == V.NEGATIVE, F.col("block"))).alias("negative"),
    )
    fields = {name: F.col(name) for name in ("topic", "positive", "negative")}
    return sides.select(group, render(V.PROS_CONS_PROMPT, **fields).alias("prompt"))


def topic_prompts(gated: DataFrame, questions: DataFrame) -> DataFrame:
    named = gated.join(questions.select("question_id", "question"), "question_id")
    return pros_cons_prompts(named, "question_id", F.col("question"), "number")


def product_prompts(reviews: DataFrame, key: Sequence[str] = ("review_id",)) -> DataFrame:
    """One prompt per title with enough positive and negative reviews. Texts are cut before ranking."""
    short = reviews.select("product_title", "sentiment", *key, clip(F.col("text"), V.TOPIC_CHARS).alias("text"))
    return pros_cons_prompts(
        product_samples(short, key=key), "product_title", F.col("product_title"), "rank"
    )


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs naming two different products."""
    a, b = F.col("product_a"), F.col("product_b")
    return pairs.filter(a.isNotNull() & b.isNotNull() & (a != "") & (b != "") & (a != b))


def first_reviews(reviews: DataFrame, n: int = V.COMPARE_REVIEWS, key: Sequence[str] = ("review_id",)) -> DataFrame:
    """The first ``n`` reviews of every title."""
    titled = reviews.filter(F.col("product_title").isNotNull())
    return first_n_per_group(titled, ["product_title"], [F.col(c) for c in key], n)


def compare_sides(
    reviews: DataFrame, pairs: DataFrame, min_reviews: int = V.MIN_PER_SIDE, key: Sequence[str] = ("review_id",)
) -> DataFrame:
    """Both products' first reviews, one row per pair, side and review, for pairs with enough of both.

    Reviews are cut to the first few per title before the join; pairs only ever meet
    those.
    """
    first = first_reviews(reviews, key=key)
    per_title = first.groupBy("product_title").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("rank", *key, "rating"))).alias("reviews"),
    )
    both = _join_sides(valid_pairs(pairs), per_title).filter(_enough(min_reviews))
    sides = both.select(
        "product_a",
        "product_b",
        F.explode(
            F.array(
                F.struct(F.lit("A").alias("side"), F.col("reviews_a").alias("reviews")),
                F.struct(F.lit("B").alias("side"), F.col("reviews_b").alias("reviews")),
            )
        ).alias("s"),
    )
    return sides.select("product_a", "product_b", "s.side", F.inline("s.reviews"))


def _join_sides(pairs: DataFrame, per_title: DataFrame) -> DataFrame:
    """Pairs with one row per title on either side. Spread by AQE if one title is in very many pairs."""
    columns = [c for c in per_title.columns if c != "product_title"]
    for letter in ("a", "b"):
        side = per_title.select(
            F.col("product_title").alias(f"product_{letter}"),
            *[F.col(c).alias(f"{c}_{letter}") for c in columns],
        )
        pairs = pairs.join(side, f"product_{letter}", "left")
    return pairs


def _enough(min_reviews: int) -> Column:
    """Both sides have the reviews a comparison needs; an unknown title has none."""
    return F.coalesce((F.col("n_a") >= min_reviews) & (F.col("n_b") >= min_reviews), F.lit(False))


def compare_prompts(
    reviews: DataFrame, pairs: DataFrame, min_reviews: int = V.MIN_PER_SIDE, key: Sequence[str] = ("review_id",)
) -> DataFrame:
    """One row per valid pair: its prompt, or the fixed answer where a side is too short.

    Every title's reviews become one block of text before the join, so a title in many
    pairs is assembled once.
    """
    line = render(
        V.COMPARE_LINE, rating=rating_text(F.col("rating")), text=clip(F.col("text"), V.COMPARE_CHARS)
    )
    # Lines are cut to size before the ranking moves them.
    lines = reviews.select("product_title", *key, line.alias("line"))
    blocks = (
        first_reviews(lines, key=key)
        .groupBy("product_title")
        .agg(F.count(F.lit(1)).alias("n"), joined_lines(F.col("rank"), F.col("line")).alias("reviews"))
    )
    paired = _join_sides(valid_pairs(pairs), blocks)
    fields = {name: F.col(name) for name in ("product_a", "product_b", "reviews_a", "reviews_b")}
    return paired.select(
        "product_a",
        "product_b",
        F.when(_enough(min_reviews), render(V.COMPARE_PROMPT, **fields)).alias("prompt"),
        F.when(~_enough(min_reviews), F.lit(V.NOT_ENOUGH_TO_COMPARE)).alias("answer"),
        F.when(_enough(min_reviews), F.lit(V.COMPARE_SYSTEM)).alias("system"),
    )
