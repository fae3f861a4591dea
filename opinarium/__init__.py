"""Customer-review analytics as Spark DataFrame jobs."""

from opinarium.plans.features import detect_language, embed_hashed, embed_with, vector_norms
from opinarium.plans.ingest import clean_reviews, dedupe, needed_products, with_metadata
from opinarium.plans.latent import embed_latent, learn_latent
from opinarium.plans.marts import build_marts, read_marts
from opinarium.plans.metrics import (
    chart_contexts,
    daily_titles,
    distinct_titles,
    kpi_display,
    kpi_overview,
    leaderboard,
    price_brackets,
    sentiment_mix,
    titles_between,
)
from opinarium.functions.edges import detect_by_edges, learn_languages, load_languages, store_languages
from opinarium.operators.clusters import add_to_index, build_index, index_top_k, index_use, open_index
from opinarium.plans.parsing import parse_compare, parse_pros_cons, parse_query_plans
from opinarium.plans.products import (
    product_drilldown,
    product_images,
    product_samples,
    product_stats,
    product_top,
)
from opinarium.plans.prompts import (
    answer_prompts,
    compare_prompts,
    compare_sides,
    product_prompts,
    rewrite_prompts,
    topic_prompts,
)
from opinarium.plans.retrieval import (
    answer_hits,
    answer_sources,
    gated_candidates,
    nearest,
    retrieve,
    topic_candidates,
)
from opinarium.plans.series import daily_sentiment, product_monthly, sentiment_trend, stacked
from opinarium.plans.sessions import append_turns, last_turns
from opinarium.session import build_session
from opinarium.sources.readers import read_products, read_raw_reviews, read_reviews, read_vectors, split_raw_reviews
from opinarium.sources.writers import write_parquet
