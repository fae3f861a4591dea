"""From questions to the reviews that answer them, for a whole table of questions.

Inputs
    corpus     review_id, embedding, product_title, rating, sentiment, text
    queries    question_id, query_no, query_vec: one row per query variant
    questions  question_id, question, sentiment, product_hint: one row per question
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinarium import fixed as V
from opinarium.functions.text import clip, is_blank, strip
from opinarium.operators.clusters import VectorIndex, grid_index_top_k, index_top_k, index_top_k_of_block
from opinarium.operators.filters import given, sentiment_allowed, soft_filter, title_pattern
from opinarium.operators.hints import pattern_matches
from opinarium.operators.search import attach, grid_top_k, merge_variants, searched, top_k, top_k_of_block
from opinarium.plans.products import both_sides

FACTS = ("product_title", "rating", "sentiment")


def clean_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """Stripped questions; blank ones are dropped."""
    return questions.filter(~is_blank(F.col(column))).withColumn(column, strip(F.col(column)))


def variants(plans: DataFrame, limit: int = V.MAX_VARIANTS) -> DataFrame:
    """One row per query variant of a plan, at most ``limit`` of them, for an encoder to fill."""
    first = F.slice("search_queries", 1, limit)
    return plans.select("question_id", F.posexplode(first).alias("query_no", "query"))


def _used(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("query_no") < V.MAX_VARIANTS)


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int = V.ANSWER_CANDIDATES, index: VectorIndex | None = None
) -> DataFrame:
    """The ``k`` best reviews of each variant, unmerged; found in the ``index`` of the corpus if there is one."""
    return top_k(corpus, _used(queries), k) if index is None else index_top_k(index, _used(queries), k)


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = V.ANSWER_CANDIDATES,
    facts: bool = False,
    index: VectorIndex | None = None,
) -> DataFrame:
    """Reviews found by any variant, with the best score and a ``position`` per question.

    A review counts for a variant only if it is among that variant's ``k`` best, so up
    to three times ``k`` reviews come back. ``facts`` adds title, rating and label. With an ``index`` of the
    corpus the vectors are read from there.
    """

    def job(block: DataFrame) -> DataFrame:
        found = top_k_of_block(corpus, block, k) if index is None else index_top_k_of_block(index, block, k)
        return merge_variants(found)

    def at_once(many: DataFrame, dims: int, groups: int) -> DataFrame:
        if index is None:
            return grid_top_k(corpus, many, groups, k, merge=True)
        return grid_index_top_k(index, many, dims, groups, k, merge=True)

    hits = searched(_used(queries), k, job, at_once)
    return attach(hits, corpus, FACTS) if facts else hits


def by_position(hits: DataFrame, n: int, group: tuple[str, ...] = ("question_id",), rank: str = "number") -> DataFrame:
    """Renumber what is left and keep the first ``n`` of each group."""
    order = Window.partitionBy(*group).orderBy("position")
    return hits.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def _planned(
    hits: DataFrame, questions: DataFrame, fall_back_on: str | None = None, mode: str = "regex"
) -> DataFrame:
    """Hits with the sentiment and the title hint their question asks for; a hint is checked once per question."""
    hint = F.col("product_hint")
    if fall_back_on:
        hint = F.coalesce(F.nullif(hint, F.lit("")), F.col(fall_back_on))
    asked = questions.select("question_id", F.col("sentiment").alias("_asked"), hint.alias("_hint"))
    return hits.join(asked.withColumn("_pattern", title_pattern(F.col("_hint"), mode)), "question_id")


def _of_sentiment(planned: DataFrame) -> DataFrame:
    return planned.filter(sentiment_allowed(F.col("sentiment"), F.col("_asked")))


def _of_title(planned: DataFrame, min_matches: int) -> DataFrame:
    matched = pattern_matches(F.col("product_title"), F.col("_hint"), F.col("_pattern"))
    return soft_filter(planned, matched, given(F.col("_hint")), min_matches, ["question_id"])


def filter_sentiment(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Drop hits whose sentiment differs from the one asked for; there is no way back."""
    return _of_sentiment(_planned(hits, questions, mode="literal")).drop("_asked", "_hint", "_pattern")


def filter_title(
    hits: DataFrame,
    questions: DataFrame,
    min_matches: int = V.ANSWER_MIN_MATCHES,
    mode: str = "regex",
    fall_back_on: str | None = None,
) -> DataFrame:
    """Keep hits whose title matches the hint, if enough of a question's hits do.

    ``fall_back_on`` names the question column that stands in for a missing hint.
    """
    planned = _planned(hits, questions, fall_back_on, mode)
    return _of_title(planned, min_matches).drop("_asked", "_hint", "_pattern")


def filter_answers(hits: DataFrame, questions: DataFrame, mode: str = "regex") -> DataFrame:
    """Both filters of an answer, the title one counting what the sentiment one left."""
    kept = _of_sentiment(_planned(hits, questions, mode=mode))
    return _of_title(kept, V.ANSWER_MIN_MATCHES).drop("_asked", "_hint", "_pattern")


def answer_hits(
    corpus: DataFrame,
    queries: DataFrame,
    questions: DataFrame,
    n: int = V.ANSWER_HITS,
    k: int = V.ANSWER_CANDIDATES,
    mode: str = "regex",
    index: VectorIndex | None = None,
) -> DataFrame:
    """The ``n`` reviews that support each answer, numbered from 1, with their text.

    Titles and labels are fetched for all candidates, the wide text for the last ``n`` only.
    """

    found = retrieve(corpus, queries, k, facts=True, index=index)
    best = by_position(filter_answers(found, questions, mode), n)
    return attach(best, corpus, ["text"])


def answer_sources(hits: DataFrame, n: int = V.ANSWER_SOURCES) -> DataFrame:
    """The sources displayed with an answer."""
    return hits.filter(F.col("number") <= n).select(
        "question_id", "number", "product_title", "rating", "text"
    )


def topic_candidates(
    corpus: DataFrame,
    queries: DataFrame,
    questions: DataFrame,
    k: int = V.TOPIC_CANDIDATES,
    per_side: int = V.TOPIC_PER_SIDE,
    mode: str = "regex",
    index: VectorIndex | None = None,
    chars: int | None = None,
) -> DataFrame:
    """The best positive and negative reviews on each topic, before the gate.

    The topic itself is the title hint where the plan has none; the plan's sentiment
    plays no part. With ``chars`` texts are cut to so many characters before they meet the hits.
    """

    found = retrieve(corpus, queries, k, facts=True, index=index)
    kept = filter_title(found, questions, V.TOPIC_MIN_MATCHES, mode, fall_back_on="question")
    two_sided = kept.filter(F.col("sentiment").isin(V.POSITIVE, V.NEGATIVE))
    best = by_position(two_sided, per_side, ("question_id", "sentiment"))
    texts = corpus if chars is None else corpus.withColumn("text", clip(F.col("text"), chars))
    return attach(best, texts, ["text"])


def gated_candidates(candidates: DataFrame, min_side: int = V.MIN_PER_SIDE) -> DataFrame:
    """Candidates of topics with at least ``min_side`` reviews on both sides."""
    return both_sides(candidates, ["question_id"], min_side)
