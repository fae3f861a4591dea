"""One entry per operator: each callable takes a session and a data folder.

Every query reads whole tables; the only limits are those that are the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import opinarium as op
from catalog.views import KEY, load
from opinarium import fixed as V
from opinarium.functions.reviews import day_text
from opinarium.operators.filters import given, title_pattern
from opinarium.operators.hints import pattern_matches
from opinarium.operators.ranking import hash_sample
from opinarium.plans import batches, ingest, metrics, products, prompts, retrieval
from opinarium.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- scans and sinks ----------------------------------------------------------


@query
def scan_reviews(spark, sf):
    return load(spark, sf, "rv_users")


@query
def scan_vectors(spark, sf):
    vectors = load(spark, sf, "embeddings")
    dims = F.size("embedding")
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"), F.min(dims).alias("min_dims"), F.max(dims).alias("max_dims")
    )


@query
def sink_roundtrip(spark, sf):
    return op.write_parquet(load(spark, sf, "rv"), fresh_path(spark, "reviews"))


@query
def marts_roundtrip(spark, sf):
    marts = op.build_marts(load(spark, sf, "rv"), fresh_path(spark, "marts"))
    total = {"daily": "pos", "brackets": "review_count", "top_products": "review_count", "sample": "product_id"}
    parts = [
        table.agg(
            F.lit(name).alias("mart"), F.count(F.lit(1)).alias("n_rows"), F.sum(total[name]).alias("total")
        )
        for name, table in marts.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _mart(name: str) -> Query:
    def mart(spark, sf):
        return op.build_marts(load(spark, sf, "rv"), fresh_path(spark, "marts"), names=[name])[name]

    return mart


QUERIES["mart_daily"] = _mart("daily")
QUERIES["mart_brackets"] = _mart("brackets")
QUERIES["mart_top_products"] = _mart("top_products")
QUERIES["mart_sample"] = _mart("sample")


@query
def reader_brackets(spark, sf):
    """Written, read through the declared schema, and aggregated."""
    path = fresh_path(spark, "reviews")
    op.write_parquet(load(spark, sf, "rv").withColumn("text", F.lit("")), path)
    return op.price_brackets(op.read_reviews(spark, path))


def _batches(spark, sf):
    """The aggregates of reviews that came in two batches, of which the second has days of all months of the first."""
    reviews, path = load(spark, sf, "rv"), fresh_path(spark, "states")
    late = F.col("order_id") % 3 == 0
    batches.add_batch(reviews.filter(~late), path, "first")
    batches.refresh_daily(spark, path)
    batches.add_batch(reviews.filter(late), path, "late")
    return reviews, path


@query
def batches_daily(spark, sf):
    _, path = _batches(spark, sf)
    return batches.refresh_daily(spark, path, batches.touched_months(spark, path, ["late"]))


@query
def batches_brackets(spark, sf):
    _, path = _batches(spark, sf)
    return batches.merged_brackets(spark, path)


@query
def batches_top_products(spark, sf):
    reviews, path = _batches(spark, sf)
    return batches.merged_leaderboard(spark, path, reviews)


# --- overview, mix, brackets, leaderboard ---------------------------------------


@query
def kpi_overview(spark, sf):
    return op.kpi_overview(load(spark, sf, "rv"))


@query
def kpi_distinct_approx(spark, sf):
    """Whether the sketch comes within three percent of the exact number."""
    counted = op.distinct_titles(load(spark, sf, "rv"))
    near = F.abs(F.col("sketched") - F.col("unique_products")) <= 0.03 * F.col("unique_products")
    return counted.select("unique_products", near.alias("within_3_pct"))


@query
def kpi_display(spark, sf):
    return op.kpi_display(op.kpi_overview(load(spark, sf, "rv")))


@query
def sentiment_mix(spark, sf):
    return op.sentiment_mix(op.kpi_overview(load(spark, sf, "rv")))


@query
def price_brackets(spark, sf):
    return op.price_brackets(load(spark, sf, "rv"))


@query
def top_products(spark, sf):
    return op.leaderboard(load(spark, sf, "rv"))


@query
def top_products_40(spark, sf):
    return metrics.top_of(op.leaderboard(load(spark, sf, "rv")))


@query
def chart_context(spark, sf):
    return op.chart_contexts(load(spark, sf, "rv"))


@query
def sample_reviews(spark, sf):
    return hash_sample(load(spark, sf, "rv"), KEY, V.DISPLAY_SAMPLE)


# --- series ----------------------------------------------------------------------


@query
def daily_sentiment(spark, sf):
    return op.daily_sentiment(load(spark, sf, "rv"))


def _trend(window: str) -> Query:
    def trend(spark, sf):
        return op.sentiment_trend(op.daily_sentiment(load(spark, sf, "rv")), window)

    return trend


QUERIES["trend_all"] = _trend("ALL")
QUERIES["trend_1y"] = _trend("1Y")
QUERIES["trend_5y"] = _trend("5Y")


@query
def product_monthly(spark, sf):
    return op.product_monthly(load(spark, sf, "rv"))


@query
def product_monthly_stacked(spark, sf):
    return op.stacked(op.product_monthly(load(spark, sf, "rv")))


# --- products ----------------------------------------------------------------------


@query
def product_stats(spark, sf):
    return op.product_stats(load(spark, sf, "rv"))


@query
def leaderboard_stats(spark, sf):
    reviews = load(spark, sf, "rv")
    return products.stats_of(metrics.top_of(op.leaderboard(reviews)), reviews)


@query
def product_samples(spark, sf):
    return op.product_samples(load(spark, sf, "rv"), key=KEY).select(
        "product_title", "sentiment", "rank", *KEY, "rating"
    )


@query
def product_top3(spark, sf):
    return op.product_top(load(spark, sf, "rv"), key=KEY).select(
        "product_title", "sentiment", "rank", *KEY, "rating", day_text(F.col("review_date")).alias("day")
    )


@query
def product_image(spark, sf):
    return op.product_images(load(spark, sf, "rv"))


@query
def product_labels(spark, sf):
    return products.product_labels(load(spark, sf, "rv"))


@query
def product_drilldown(spark, sf):
    """Arrays are written out as text, so that other engines can compare them."""

    def months(m):
        return F.concat_ws(",", day_text(m["month"]), *[m[s].cast("string") for s in V.SENTIMENTS])

    def shown(r):
        return F.concat_ws(",", *[r[c].cast("string") for c in ("rank", *KEY)])

    bundle = op.product_drilldown(load(spark, sf, "rv"), key=KEY, text=())
    for name, text in (("months", months), ("top_pos", shown), ("top_neg", shown)):
        bundle = bundle.withColumn(name, F.array_join(F.transform(name, text), ";"))
    return bundle


@query
def compare_pairs(spark, sf):
    return op.compare_sides(load(spark, sf, "rv"), load(spark, sf, "pairs"), key=KEY)


# --- ingest --------------------------------------------------------------------------


@query
def ingest_limit(spark, sf):
    return ingest.first_rows(load(spark, sf, "raw_reviews"), 150)


@query
def ingest_semi_meta(spark, sf):
    return op.needed_products(load(spark, sf, "products"), load(spark, sf, "raw_reviews"))


@query
def ingest_join_meta(spark, sf):
    return op.with_metadata(load(spark, sf, "raw_reviews"), load(spark, sf, "products"))


@query
def ingest_dedupe(spark, sf):
    return op.dedupe(load(spark, sf, "raw_reviews"))


@query
def dedupe_batches(spark, sf):
    """Raw reviews in three batches of rising ids, each held against the digests of those before it."""
    raw, store = load(spark, sf, "raw_reviews"), fresh_path(spark, "seen")
    third = raw.agg(F.max("review_id")).first()[0] // 3 + 1
    number = F.floor(F.col("review_id") / third)
    kept = [batches.dedupe_batch(raw.filter(number == i), store, f"b{i}") for i in range(3)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query
def docs_dedupe(spark, sf):
    return op.dedupe(load(spark, sf, "documents"), key=("text",), id_column="doc_id")


@query
def ingest_parse_ts(spark, sf):
    timed = ingest.with_instant(load(spark, sf, "raw_reviews"))
    instant = F.date_format("review_ts", "yyyy-MM-dd HH:mm:ss")
    return timed.select("review_id", instant.alias("review_ts"), "review_date")


@query
def ingest_drop_short(spark, sf):
    return ingest.drop_short(load(spark, sf, "raw_reviews"))


@query
def ingest_english(spark, sf):
    return ingest.english_only(load(spark, sf, "raw_reviews"))


@query
def ingest_sentiment(spark, sf):
    return ingest.with_sentiment(load(spark, sf, "rv").select(*KEY, "rating"))


@query
def ingest_clean(spark, sf):
    cleaned = op.clean_reviews(load(spark, sf, "raw_reviews"), load(spark, sf, "products"))
    return op.write_parquet(cleaned.drop("review_ts"), fresh_path(spark, "cleaned"))


@query
def ingest_raw_json(spark, sf):
    """Raw reviews as they are found: JSON lines without ids and labels, ratings as ``5.0``."""
    path = fresh_path(spark, "raw-json")
    found = load(spark, sf, "raw_reviews").drop("review_id", "lang").withColumn("rating", F.col("rating").cast("double"))
    found.withColumns({c: F.col(c).cast("string") for c in ("user_id", "parent_asin")}).write.json(path)
    raw = op.read_raw_reviews(spark, path).withColumn("parent_asin", F.col("parent_asin").cast("bigint"))
    return op.clean_reviews(raw, load(spark, sf, "products")).select("user_id", "parent_asin", "text", "product_title")


@query
def ingest_quarantine(spark, sf):
    """Raw reviews as JSON lines, some of them spoiled: rows that could be read, and rejected ones by reason."""
    path = fresh_path(spark, "spoiled-json")
    found = load(spark, sf, "raw_reviews").withColumns({c: F.col(c).cast("string") for c in ("user_id", "parent_asin")})
    number = F.col("review_id")
    rating = F.col("rating") + F.when(number % 7 == 3, 0.5).otherwise(0.0)
    when = F.when(number % 13 == 6, "soon").otherwise(F.col("ts_ms").cast("string"))
    line = F.to_json(F.struct(*[c for c in found.columns if c not in ("rating", "ts_ms")], rating.alias("rating")))
    # A timestamp goes in as it is written; a truncated line lacks its last sign.
    quoted = F.when(number % 13 == 6, F.concat(F.lit('"'), when, F.lit('"'))).otherwise(when)
    whole = F.concat(F.expr("left(line, length(line) - 1)"), F.lit(',"ts_ms":'), quoted, F.lit("}"))
    lines = found.withColumn("line", line).select(
        F.when(number % 11 == 5, F.expr("left(line, length(line) - 1)")).otherwise(whole).alias("value")
    )
    lines.write.text(path)
    landed = op.split_raw_reviews(spark, path)
    typed = landed.typed.groupBy(F.lit("typed").alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("rating").cast("bigint").alias("ratings")
    )
    rejected = landed.rejected.groupBy(F.array_join("reasons", ", ").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
    return typed.unionByName(
        rejected.withColumn("ratings", F.lit(None).cast("bigint"))
    )


@query
def review_cards(spark, sf):
    return products.review_cards(ingest.with_instant(load(spark, sf, "raw_reviews")))


@query
def source_previews(spark, sf):
    return products.source_previews(
        op.with_metadata(load(spark, sf, "raw_reviews"), load(spark, sf, "products"))
    )


@query
def detect_language(spark, sf):
    return op.detect_language(load(spark, sf, "documents")).select("doc_id", "lang", "detected")


@query
def detect_language_learned(spark, sf):
    """Learned from four fifths of the documents, applied to all."""
    docs = load(spark, sf, "documents")
    held_out = F.col("doc_id") % 5 == 0
    model = op.learn_languages(docs.filter(~held_out))
    found = op.detect_by_edges(docs, model)
    return found.select("doc_id", "lang", held_out.alias("held_out"), "detected")


# --- retrieval -------------------------------------------------------------------------


def _inputs(spark, sf):
    return load(spark, sf, "corpus"), load(spark, sf, "queries"), load(spark, sf, "questions")


def _candidates(spark, sf, k=V.ANSWER_CANDIDATES):
    """Retrieved hits with title, rating and label, and the questions they belong to."""
    corpus, queries, questions = _inputs(spark, sf)
    return op.retrieve(corpus, queries, k, facts=True), questions


@query
def vector_norms(spark, sf):
    norms = op.vector_norms(load(spark, sf, "embeddings"), id_column="vec_id")
    return norms.withColumn("norm", F.round("norm", 6))


@query
def knn_single(spark, sf):
    corpus, queries, _ = _inputs(spark, sf)
    return op.nearest(corpus, queries)


@query
def knn_indexed(spark, sf):
    """The same hits, read from cells of clustered vectors."""
    corpus, queries, _ = _inputs(spark, sf)
    return op.retrieve(corpus, queries, index=op.build_index(corpus))


@query
def knn_multi(spark, sf):
    corpus, queries, _ = _inputs(spark, sf)
    return op.retrieve(corpus, queries)


@query
def filter_sentiment(spark, sf):
    hits, questions = _candidates(spark, sf)
    return retrieval.filter_sentiment(hits, questions)


@query
def filter_title_hint(spark, sf):
    hits, questions = _candidates(spark, sf)
    hint = F.col("product_hint")
    hinted = questions.filter(given(hint)).select("question_id", "product_hint", title_pattern(hint).alias("_pattern"))
    matched = pattern_matches(F.col("product_title"), hint, F.col("_pattern"))
    return hits.join(hinted, "question_id").filter(matched).drop("_pattern")


@query
def soft_filter_3(spark, sf):
    hits, questions = _candidates(spark, sf)
    return retrieval.filter_answers(hits, questions)


@query
def soft_filter_20(spark, sf):
    hits, questions = _candidates(spark, sf, V.TOPIC_CANDIDATES)
    return retrieval.filter_title(hits, questions, V.TOPIC_MIN_MATCHES, fall_back_on="question")


@query
def rag_hits(spark, sf):
    return op.answer_hits(*_inputs(spark, sf))


@query
def rag_sources(spark, sf):
    return op.answer_sources(op.answer_hits(*_inputs(spark, sf)))


@query
def rag_context(spark, sf):
    return prompts.context_lines(op.answer_hits(*_inputs(spark, sf)))


@query
def rag_prompt(spark, sf):
    """Few reviews are negative here, so some questions find nothing."""
    _, queries, questions = _inputs(spark, sf)
    corpus = load(spark, sf, "mild_corpus")
    return op.answer_prompts(op.answer_hits(corpus, queries, questions), questions)


@query
def proscons_candidates(spark, sf):
    return op.topic_candidates(*_inputs(spark, sf))


@query
def proscons_gate(spark, sf):
    gated = op.gated_candidates(op.topic_candidates(*_inputs(spark, sf)))
    return gated.select("question_id", "sentiment", "number", "review_id")


@query
def proscons_prompt(spark, sf):
    corpus, queries, questions = _inputs(spark, sf)
    candidates = op.topic_candidates(corpus, queries, questions, chars=V.TOPIC_CHARS)
    return op.topic_prompts(op.gated_candidates(candidates), questions)


@query
def product_prompt(spark, sf):
    return op.product_prompts(load(spark, sf, "text_reviews"))


@query
def compare_prompt(spark, sf):
    reviews = load(spark, sf, "text_reviews")
    titles = reviews.select("product_title").distinct()
    pairs = titles.select(F.col("product_title").alias("product_a")).withColumn(
        "product_b", F.concat(F.lit("src"), (F.substring("product_a", 4, 9).cast("int") + 1).cast("string"))
    )
    return op.compare_prompts(reviews, pairs)


# --- texts in and out ---------------------------------------------------------------------


@query
def rewrite_prompt(spark, sf):
    questions = load(spark, sf, "questions")
    kinds = [("question", False), ("topic", True)]
    asked, topics = [
        prompts.rewrite_prompts(questions, topics=flag).withColumn("kind", F.lit(kind)) for kind, flag in kinds
    ]
    return asked.unionByName(topics)


@query
def parse_query_plan(spark, sf):
    plans = op.parse_query_plans(load(spark, sf, "raw_plans"))
    return plans.withColumn("search_queries", F.array_join("search_queries", "|"))


@query
def plan_variants(spark, sf):
    plans = op.parse_query_plans(load(spark, sf, "raw_plans").withColumnRenamed("plan_id", "question_id"))
    return retrieval.variants(plans)


@query
def parse_proscons(spark, sf):
    return op.parse_pros_cons(load(spark, sf, "pros_cons_texts"))


@query
def parse_compare(spark, sf):
    return op.parse_compare(load(spark, sf, "compare_texts"))


@query
def question_clean(spark, sf):
    """What users say, with white space around it; system turns stand for blank input."""
    said = F.when(F.col("role") == "system", F.lit(" \t\n")).otherwise(
        F.concat(F.lit("\n "), F.col("text"), F.lit("\t"))
    )
    turns = load(spark, sf, "conversations").select("conv_id", "turn", said.alias("question"))
    return retrieval.clean_questions(turns)


# --- sessions and features ----------------------------------------------------------------


@query
def session_last5(spark, sf):
    return op.last_turns(load(spark, sf, "conversations"), session="conv_id")


@query
def session_append(spark, sf):
    """Every conversation gets one more turn."""
    history = load(spark, sf, "conversations")
    new = history.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select(
        "conv_id", "turn", F.lit("user").alias("role"), F.concat(F.lit("turn "), F.col("turn")).alias("text")
    )
    return op.append_turns(history, new, session="conv_id")


@query
def embed_hashed(spark, sf):
    return op.embed_hashed(load(spark, sf, "documents"), id_column="doc_id")


@query
def embed_latent(spark, sf):
    """Vectors as they are stored for the search."""
    docs = load(spark, sf, "documents")
    embedded = op.embed_latent(docs, op.learn_latent(docs), id_column="doc_id")
    return op.write_parquet(embedded, fresh_path(spark, "latent"))
