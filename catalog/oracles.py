"""The same results in SQL for another engine, written independently of the jobs."""

from __future__ import annotations

import re

from catalog.views import with_views
from opinarium import fixed as V
from opinarium.functions.language import FREQUENT_WORDS

ORDER = "review_id"


def _text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def _render(template: str, **fields: str) -> str:
    """A template as a concatenation of literals and expressions."""
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    parts = [fields[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else _text(p) for p in pieces]
    return "concat(" + ", ".join(parts) + ")"


SHARE = "avg(CASE WHEN sentiment = '{0}' THEN 1.0 ELSE 0.0 END::DOUBLE)"
POS, NEG = SHARE.format("pos"), SHARE.format("neg")

KPI = f"""
SELECT count(*) AS total_reviews, avg(rating) AS avg_rating, {POS} * 100 AS pos_pct,
       {NEG} * 100 AS neg_pct, count(DISTINCT product_title) AS unique_products
FROM rv"""

DAILY = """
SELECT review_date AS date, count(*) FILTER (sentiment = 'pos') AS pos,
       count(*) FILTER (sentiment = 'neu') AS neu, count(*) FILTER (sentiment = 'neg') AS neg
FROM rv WHERE review_date IS NOT NULL GROUP BY 1"""

BRACKETS = """
SELECT bracket_no, bracket, avg(rating) AS avg_rating, count(*) AS review_count
FROM (SELECT rating,
             CASE WHEN price < 25 THEN '0-25' WHEN price < 50 THEN '25-50' WHEN price < 100 THEN '50-100'
                  WHEN price < 200 THEN '100-200' ELSE '200+' END AS bracket,
             CASE WHEN price < 25 THEN 1 WHEN price < 50 THEN 2 WHEN price < 100 THEN 3
                  WHEN price < 200 THEN 4 ELSE 5 END AS bracket_no
      FROM rv WHERE price IS NOT NULL AND price >= 0) b
GROUP BY 1, 2"""

TOP = f"""
SELECT *, 1 - pos_pct - neg_pct AS neu_pct
FROM (SELECT product_title, count(*) AS review_count, avg(rating) AS avg_rating, {POS} AS pos_pct,
             {NEG} AS neg_pct,
             arg_min_null(image_url, review_id) AS image_url
      FROM rv GROUP BY 1) t
ORDER BY review_count DESC, product_title LIMIT {{limit}}"""

QUARANTINE = """
SELECT reason, count(*) AS n_rows, sum(CASE WHEN reason = 'typed' THEN rating END)::BIGINT AS ratings
FROM (SELECT rating,
             CASE WHEN review_id % 11 = 5 THEN 'malformed JSON'
                  WHEN review_id % 13 = 6 AND review_id % 7 = 3 THEN 'ts_ms: string, rating: not whole'
                  WHEN review_id % 13 = 6 THEN 'ts_ms: string'
                  WHEN review_id % 7 = 3 THEN 'rating: not whole' ELSE 'typed' END AS reason
      FROM raw_reviews) r
GROUP BY 1"""

SAMPLE = f"""
SELECT * FROM rv
ORDER BY substr(md5(review_id::VARCHAR), 1, 15), {ORDER} LIMIT 5000"""

MONTHLY = """
SELECT product_title, month, pos, neu, neg
FROM (SELECT product_title, date_trunc('month', review_date)::DATE AS month,
             count(*) FILTER (sentiment = 'pos') AS pos, count(*) FILTER (sentiment = 'neu') AS neu,
             count(*) FILTER (sentiment = 'neg') AS neg
      FROM rv
      WHERE product_title IN (SELECT product_title FROM rv GROUP BY 1 HAVING count(*) >= 5)
      GROUP BY 1, 2) m
WHERE month IS NOT NULL AND pos + neu + neg > 0"""

STATS = f"""
SELECT product_title, count(*) AS review_count, avg(rating) AS avg_rating, {POS} * 100 AS pos_pct,
       {NEG} * 100 AS neg_pct
FROM rv GROUP BY 1"""

FIRST = f"""
SELECT *, row_number() OVER (PARTITION BY product_title, sentiment ORDER BY {ORDER})::INT AS rank
FROM rv WHERE sentiment IN ('pos', 'neg')"""

IMAGE = f"""
SELECT product_title, image_url, image_url IS NOT NULL AND image_url <> '' AS has_image
FROM rv QUALIFY row_number() OVER (PARTITION BY product_title ORDER BY {ORDER}) = 1"""


def _trend(days: int | None) -> str:
    start = "" if days is None else f"WHERE date >= (SELECT max(date) FROM daily) - {days}"
    means = ", ".join(
        f"avg({c}) OVER (ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS {c}"
        for c in V.SENTIMENTS
    )
    return f"SELECT date, {means} FROM (SELECT * FROM ({DAILY}) {start}) d".replace(
        "FROM daily", f"FROM ({DAILY}) x"
    )


DRILLDOWN = f"""
SELECT s.product_title, review_count, avg_rating, pos_pct, neg_pct, coalesce(months, '') AS months, image_url,
       has_image, coalesce(top_pos, '') AS top_pos, coalesce(top_neg, '') AS top_neg,
       coalesce(n_pos >= 3 AND n_neg >= 3, false) AS has_summary
FROM ({STATS}) s
LEFT JOIN (SELECT product_title, string_agg(concat_ws(',', month, pos, neu, neg), ';' ORDER BY month) AS months
           FROM ({MONTHLY}) GROUP BY 1) m USING (product_title)
JOIN ({IMAGE}) i USING (product_title)
LEFT JOIN (SELECT product_title,
                  string_agg(concat_ws(',', rank, {ORDER}), ';' ORDER BY rank)
                      FILTER (sentiment = 'pos' AND rank <= 3) AS top_pos,
                  string_agg(concat_ws(',', rank, {ORDER}), ';' ORDER BY rank)
                      FILTER (sentiment = 'neg' AND rank <= 3) AS top_neg,
                  count(*) FILTER (sentiment = 'pos') AS n_pos, count(*) FILTER (sentiment = 'neg') AS n_neg
           FROM ({FIRST}) GROUP BY 1) f USING (product_title)"""

CHART = f"""
WITH kpi AS ({KPI}),
     figures AS (SELECT format('{{:.1f}}', pos_pct) AS pos, format('{{:.1f}}', neg_pct) AS neg,
                        format('{{:.1f}}', 100 - pos_pct - neg_pct) AS neu,
                        format('{{:,}}', total_reviews) AS total FROM kpi),
     charts AS (
       SELECT {_text(V.TREND_CHART)} AS chart,
              {_render(V.TREND_CONTEXT, pos="pos", neg="neg", total="total")} AS context FROM figures
       UNION ALL
       SELECT {_text(V.MIX_CHART)},
              {_render(V.MIX_CONTEXT, pos="pos", neg="neg", neu="neu", total="total")} FROM figures
       UNION ALL
       SELECT {_text(V.PRICE_CHART)}, {_render(V.PRICE_CONTEXT, rows="rows")}
       FROM (SELECT string_agg({_render(
           V.PRICE_LINE, bracket="bracket", rating="format('{:.2f}', avg_rating)",
           total="format('{:,}', review_count)")}, chr(10) ORDER BY bracket_no) AS rows FROM ({BRACKETS}) b) r)
SELECT chart, context, {_render(V.CHART_PROMPT, chart="chart", context="context")} AS prompt,
       {_text(V.CHART_SYSTEM)} AS system FROM charts"""

COMPARE_SIDES = f"""
WITH first AS (SELECT *, (row_number() OVER (PARTITION BY product_title ORDER BY {ORDER}))::INT AS rank
               FROM rv QUALIFY rank <= 15),
     long AS (SELECT product_title FROM first GROUP BY 1 HAVING count(*) >= 3),
     kept AS (SELECT * FROM pairs WHERE product_a <> product_b
              AND product_a IN (SELECT product_title FROM long) AND product_b IN (SELECT product_title FROM long))
SELECT product_a, product_b, 'A' AS side, rank, {ORDER}, rating FROM kept JOIN first ON product_title = product_a
UNION ALL
SELECT product_a, product_b, 'B', rank, {ORDER}, rating FROM kept JOIN first ON product_title = product_b"""

STRIP = r"regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"

RAW = "review_id, user_id, parent_asin, text, lang, rating, ts_ms"
DAY = "epoch_ms(ts_ms)::DATE"

CLEAN = f"""
SELECT {RAW}, product_title, price, brand, {DAY} AS review_date,
       CASE WHEN rating <= 2 THEN 'neg' WHEN rating = 3 THEN 'neu' WHEN rating >= 4 THEN 'pos' END AS sentiment
FROM (SELECT * FROM raw_reviews
      QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin, text ORDER BY review_id) = 1) u
JOIN products USING (parent_asin)
WHERE length({STRIP.format("text")}) >= 20 AND lang = 'en'"""


def _language() -> str:
    votes = ", ".join(
        f"list_sum(list_transform(words, lambda w: CASE WHEN list_contains({words.split()!r}, w) THEN 1 ELSE 0 END))"
        f" AS {language}"
        for language, words in FREQUENT_WORDS.items()
    )
    best = " ".join(
        f"WHEN greatest(en, de, es, fr) = {language} THEN '{language}'" for language in FREQUENT_WORDS
    )
    return f"""
SELECT doc_id, lang, CASE WHEN greatest(en, de, es, fr) = 0 THEN NULL {best} END AS detected
FROM (SELECT doc_id, lang, {votes}
      FROM (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS words FROM documents) d) v"""


def _code(word: str, side: int) -> str:
    letters = [f"(CASE WHEN length({word}) >= {i} THEN unicode(substr({word}, {i}, 1)) ELSE 0 END % 32)" for i in (1, 2, 3)]
    return f"((({side} * 32 + {letters[0]}) * 32 + {letters[1]}) * 32 + {letters[2]})"


# Learned from four fifths of the labelled documents, applied to all.
LEARNED = f"""
WITH words AS (
  SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents
), codes AS (
  SELECT doc_id, lang, unnest([{_code("word", 0)}, {_code("right(word, 3)", 1)}]) AS code FROM words WHERE word <> ''
), counts AS (
  SELECT lang AS l, code, count(*) AS n FROM codes WHERE lang IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1, 2
), totals AS (
  SELECT l, sum(n)::BIGINT AS total FROM counts GROUP BY 1
), scores AS (
  SELECT doc_id, t.l, sum(round(1000 * ln((coalesce(n, 0) + 1) / (total + 65536)))::BIGINT) AS score
  FROM codes CROSS JOIN totals t LEFT JOIN counts c ON c.l = t.l AND c.code = codes.code
  GROUP BY 1, 2
), best AS (
  SELECT doc_id, l FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, l) = 1
)
SELECT d.doc_id, lang, doc_id % 5 = 0 AS held_out, l AS detected FROM documents d LEFT JOIN best USING (doc_id)"""

# Copies differ in rating and time only, so what they share is compared.
RAW_JSON = f"""
SELECT DISTINCT user_id::VARCHAR AS user_id, parent_asin, text, product_title
FROM raw_reviews JOIN products USING (parent_asin)
JOIN (SELECT doc_id AS review_id, detected FROM ({_language()}) l) d USING (review_id)
WHERE length({STRIP.format("text")}) >= 20 AND detected = 'en'"""


# --- retrieval -------------------------------------------------------------------------


def _search(k: int) -> str:
    """Common table expressions: ranked per query, merged per question, joined to facts."""
    return f"""
scored AS (SELECT question_id, query_no, review_id,
                  round(list_inner_product(query_vec::DOUBLE[], embedding::DOUBLE[]), 9) AS score
           FROM queries, corpus WHERE query_no < 3),
nearest AS (SELECT *, (row_number() OVER (PARTITION BY question_id, query_no
                                          ORDER BY score DESC, review_id))::INT AS rank
            FROM scored QUALIFY rank <= {k}),
merged AS (SELECT question_id, review_id, max(score) AS score, min((query_no, rank)) AS seen
           FROM nearest GROUP BY 1, 2),
found AS (SELECT question_id, review_id, score,
                 (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen, review_id))::INT
                     AS position
          FROM merged),
hits AS (SELECT found.*, product_title, rating, sentiment FROM found JOIN corpus USING (review_id)),
asked AS (SELECT question_id, question, sentiment AS wanted, product_hint FROM questions)"""


FACTS = "question_id, review_id, position, product_title, rating, sentiment"

BY_SENTIMENT = """
by_sentiment AS (SELECT hits.*, question, product_hint FROM hits JOIN asked USING (question_id)
                 WHERE wanted NOT IN ('pos', 'neg') OR sentiment = wanted)"""

SOFT_3 = """
flagged AS (SELECT *, coalesce(regexp_matches(product_title, nullif(product_hint, 'src1++('), 'i'), false) AS hit
            FROM by_sentiment),
soft AS (SELECT * FROM flagged
         QUALIFY hit OR count(*) FILTER (hit) OVER (PARTITION BY question_id) < 3)"""

SOFT_20 = """
flagged AS (SELECT hits.*, question,
                   regexp_matches(product_title, coalesce(nullif(replace(product_hint, 'src1++(', 'zzz'), ''), question), 'i') AS hit
            FROM hits JOIN asked USING (question_id)),
soft AS (SELECT * FROM flagged
         QUALIFY hit OR count(*) FILTER (hit) OVER (PARTITION BY question_id) < 20)"""

ANSWER = """
answer AS (SELECT soft.* EXCLUDE (hit), text,
                  (row_number() OVER (PARTITION BY question_id ORDER BY position))::INT AS number
           FROM soft JOIN (SELECT review_id, text FROM corpus) t USING (review_id)
           QUALIFY number <= 8)"""

TOPIC = """
topic AS (SELECT soft.* EXCLUDE (hit), text,
                 (row_number() OVER (PARTITION BY question_id, sentiment ORDER BY position))::INT AS number
          FROM soft JOIN (SELECT review_id, text FROM corpus) t USING (review_id)
          WHERE sentiment IN ('pos', 'neg') QUALIFY number <= 25),
gated AS (SELECT * FROM topic WHERE question_id IN
            (SELECT question_id FROM topic GROUP BY 1
             HAVING count(*) FILTER (sentiment = 'pos') >= 3 AND count(*) FILTER (sentiment = 'neg') >= 3))"""

CONTEXT_LINE = _render(
    V.CONTEXT_LINE, number="number", product="product_title", rating="rating", sentiment="sentiment",
    text="substr(text, 1, 500)",
)


def _retrieval(select: str, *steps: str, k: int = 40, corpus: str = "corpus") -> str:
    views = with_views("", corpus, "queries", "questions").strip()
    body = f"{', '.join([_search(k).strip(), *[s.strip() for s in steps]])} {select}"
    return f"{views}, {re.sub('(?<=[ ,])corpus(?=[ )])', corpus, body)}"


def _pros_cons(source: str, group: str, topic: str, rank: str) -> str:
    def block(label: str) -> str:
        line = _render(V.TOPIC_LINE, text="substr(text, 1, 300)")
        return f"string_agg({line}, chr(10) ORDER BY {rank}) FILTER (sentiment = '{label}')"

    prompt = _render(V.PROS_CONS_PROMPT, topic="topic", positive="positive", negative="negative")
    return f"""
SELECT {group}, {prompt} AS prompt
FROM (SELECT {group}, any_value({topic}) AS topic, {block("pos")} AS positive, {block("neg")} AS negative
      FROM {source} GROUP BY 1) b"""


PRODUCT_PROMPT = f"""
WITH first AS (SELECT *, row_number() OVER (PARTITION BY product_title, sentiment ORDER BY review_id) AS rank
               FROM text_reviews WHERE sentiment IN ('pos', 'neg') QUALIFY rank <= 15),
     full_titles AS (SELECT product_title FROM first GROUP BY 1
              HAVING count(*) FILTER (sentiment = 'pos') >= 3 AND count(*) FILTER (sentiment = 'neg') >= 3),
     samples AS (SELECT * FROM first WHERE product_title IN (SELECT product_title FROM full_titles))
{_pros_cons("samples", "product_title", "product_title", "rank")}"""

COMPARE_PROMPT = f"""
WITH first AS (SELECT *, row_number() OVER (PARTITION BY product_title ORDER BY review_id) AS rank
               FROM text_reviews QUALIFY rank <= 15),
     blocks AS (SELECT product_title, count(*) AS n,
                       string_agg({_render(V.COMPARE_LINE, rating="rating", text="substr(text, 1, 250)")},
                                  chr(10) ORDER BY rank) AS reviews
                FROM first GROUP BY 1),
     titles AS (SELECT DISTINCT product_title AS product_a,
                       concat('src', substr(product_title, 4)::INT + 1) AS product_b FROM text_reviews),
     sides AS (SELECT product_a, product_b, a.reviews AS reviews_a, b.reviews AS reviews_b,
                      coalesce(a.n >= 3 AND b.n >= 3, false) AS enough
               FROM titles LEFT JOIN blocks a ON a.product_title = product_a
                    LEFT JOIN blocks b ON b.product_title = product_b)
SELECT product_a, product_b,
       CASE WHEN enough THEN {_render(
           V.COMPARE_PROMPT, product_a="product_a", product_b="product_b", reviews_a="reviews_a",
           reviews_b="reviews_b")} END AS prompt,
       CASE WHEN NOT enough THEN {_text(V.NOT_ENOUGH_TO_COMPARE)} END AS answer,
       CASE WHEN enough THEN {_text(V.COMPARE_SYSTEM)} END AS system
FROM sides"""

PLANS = """
SELECT p_partkey AS plan_id,
       CASE WHEN p_partkey % 10 >= 7 THEN [p_name] ELSE [p_name, p_type] END AS search_queries,
       CASE p_partkey % 10 WHEN 9 THEN 'any' WHEN 8 THEN 'pos' WHEN 6 THEN 'any' ELSE 'neg' END AS sentiment,
       CASE WHEN p_partkey % 10 < 8 THEN p_brand END AS product_hint
FROM part"""

PARSED_PROS_CONS = """
SELECT p_partkey AS text_id, 'pros' AS section, 1 AS item_no, concat(p_name, ' - ', p_type) AS item FROM part
UNION ALL SELECT p_partkey, 'pros', 2, p_brand FROM part
UNION ALL SELECT p_partkey, 'cons', 1, concat('size ', p_size) FROM part"""

PARSED_COMPARE = """
SELECT p_partkey AS text_id, 'a_wins' AS section, 1 AS item_no, p_name AS item FROM part
UNION ALL SELECT p_partkey, 'a_wins', 2, concat(p_type, '** fits') FROM part
UNION ALL SELECT p_partkey, 'b_wins', 1, p_brand FROM part
UNION ALL SELECT p_partkey, 'verdict', 1, concat('Buy ', p_name, '. Size ', p_size, ' matters.') FROM part"""

ORACLES = {
    "scan_reviews": with_views("SELECT * FROM rv_users", "rv_users"),
    "scan_vectors": "SELECT count(*) AS n_vectors, min(len(embedding))::INT AS min_dims,"
    " max(len(embedding))::INT AS max_dims FROM embeddings",
    "sink_roundtrip": with_views("SELECT * FROM rv", "rv"),
    "marts_roundtrip": with_views(
        f"""SELECT 'daily' AS mart, count(*) AS n_rows, sum(pos)::BIGINT AS total FROM ({DAILY})
        UNION ALL SELECT 'brackets', count(*), sum(review_count)::BIGINT FROM ({BRACKETS})
        UNION ALL SELECT 'top_products', count(*), sum(review_count)::BIGINT FROM ({TOP.format(limit=100)})
        UNION ALL SELECT 'sample', count(*), sum(product_id)::BIGINT FROM ({SAMPLE})""",
        "rv",
    ),
    "batches_daily": with_views(DAILY, "rv"),
    "batches_brackets": with_views(BRACKETS, "rv"),
    "batches_top_products": with_views(TOP.format(limit=100), "rv"),
    "mart_daily": with_views(DAILY, "rv"),
    "mart_brackets": with_views(BRACKETS, "rv"),
    "mart_top_products": with_views(TOP.format(limit=100), "rv"),
    "mart_sample": with_views(SAMPLE, "rv"),
    "reader_brackets": with_views(BRACKETS, "rv"),
    "kpi_distinct_approx": with_views(
        "SELECT count(DISTINCT product_title) AS unique_products, true AS within_3_pct FROM rv", "rv"
    ),
    "kpi_overview": with_views(KPI, "rv"),
    "kpi_display": with_views(
        f"""SELECT format('{{:,}}', total_reviews) AS total_reviews,
        format('{{:.2f}}', avg_rating)::DOUBLE AS avg_rating, format('{{:.1f}}', pos_pct)::DOUBLE AS pos_pct,
        format('{{:.1f}}', neg_pct)::DOUBLE AS neg_pct, format('{{:.0f}}%', pos_pct) AS pos_text,
        format('{{:,}}', unique_products) AS unique_products FROM ({KPI})""",
        "rv",
    ),
    "sentiment_mix": with_views(
        f"""SELECT 'Positive' AS label, pos_pct AS pct FROM ({KPI})
        UNION ALL SELECT 'Negative', neg_pct FROM ({KPI})
        UNION ALL SELECT 'Neutral', 100 - pos_pct - neg_pct FROM ({KPI})""",
        "rv",
    ),
    "price_brackets": with_views(BRACKETS, "rv"),
    "top_products": with_views(TOP.format(limit=100), "rv"),
    "top_products_40": with_views(TOP.format(limit=40), "rv"),
    "chart_context": with_views(f"SELECT * FROM ({CHART})", "rv"),
    "sample_reviews": with_views(SAMPLE, "rv"),
    "daily_sentiment": with_views(DAILY, "rv"),
    "trend_all": with_views(_trend(None), "rv"),
    "trend_1y": with_views(_trend(365), "rv"),
    "trend_5y": with_views(_trend(1825), "rv"),
    "product_monthly": with_views(MONTHLY, "rv"),
    "product_monthly_stacked": with_views(
        f"""SELECT product_title, month, pos AS pos_top, pos + neu AS neu_top, pos + neu + neg AS neg_top
        FROM ({MONTHLY})""",
        "rv",
    ),
    "product_stats": with_views(STATS, "rv"),
    "leaderboard_stats": with_views(
        f"SELECT * FROM ({STATS}) ORDER BY review_count DESC, product_title LIMIT 40", "rv"
    ),
    "product_samples": with_views(
        f"""SELECT product_title, sentiment, rank, {ORDER}, rating FROM ({FIRST}) f WHERE rank <= 15
        AND product_title IN (SELECT product_title FROM rv GROUP BY 1
          HAVING count(*) FILTER (sentiment = 'pos') >= 3 AND count(*) FILTER (sentiment = 'neg') >= 3)""",
        "rv",
    ),
    "product_top3": with_views(
        f"""SELECT product_title, sentiment, rank, {ORDER}, rating, strftime(review_date, '%Y-%m-%d') AS day
        FROM ({FIRST}) WHERE rank <= 3""",
        "rv",
    ),
    "product_image": with_views(IMAGE, "rv"),
    "product_labels": with_views(
        """SELECT DISTINCT product_title, substr(product_title, 1, 60) AS source_label,
        substr(product_title, 1, 70) AS picker_label, substr(product_title, 1, 80) AS row_label FROM rv""",
        "rv",
    ),
    "product_drilldown": with_views(DRILLDOWN, "rv"),
    "compare_pairs": with_views(f"SELECT * FROM ({COMPARE_SIDES})", "rv", "pairs"),
    "ingest_limit": with_views("SELECT * FROM raw_reviews ORDER BY review_id LIMIT 150", "raw_reviews"),
    "ingest_semi_meta": with_views(
        "SELECT * FROM products WHERE parent_asin IN (SELECT parent_asin FROM raw_reviews)",
        "products", "raw_reviews",
    ),
    "ingest_join_meta": with_views(
        "SELECT * FROM raw_reviews JOIN products USING (parent_asin)", "products", "raw_reviews"
    ),
    "ingest_dedupe": with_views(
        """SELECT * FROM raw_reviews
        QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin, text ORDER BY review_id) = 1""",
        "raw_reviews",
    ),
    "dedupe_batches": with_views(
        """SELECT * FROM raw_reviews
        QUALIFY row_number() OVER (PARTITION BY user_id, parent_asin, text ORDER BY review_id) = 1""",
        "raw_reviews",
    ),
    "docs_dedupe": "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "ingest_parse_ts": with_views(
        f"""SELECT review_id, strftime(epoch_ms(ts_ms), '%Y-%m-%d %H:%M:%S') AS review_ts,
        {DAY} AS review_date FROM raw_reviews""",
        "raw_reviews",
    ),
    "ingest_drop_short": with_views(
        f"SELECT * FROM raw_reviews WHERE length({STRIP.format('text')}) >= 20", "raw_reviews"
    ),
    "ingest_english": with_views("SELECT * FROM raw_reviews WHERE lang = 'en'", "raw_reviews"),
    "ingest_sentiment": with_views(f"SELECT {ORDER}, rating, sentiment FROM rv", "rv"),
    "ingest_clean": with_views(CLEAN, "raw_reviews", "products"),
    "ingest_raw_json": with_views(RAW_JSON, "raw_reviews", "products"),
    "ingest_quarantine": with_views(QUARANTINE, "raw_reviews"),
    "review_cards": with_views(
        f"""SELECT review_id, rating, strftime({DAY}, '%Y-%m-%d') AS day,
        CASE WHEN length(text) > 400 THEN concat(substr(text, 1, 400), '...') ELSE text END AS body
        FROM raw_reviews""",
        "raw_reviews",
    ),
    "source_previews": with_views(
        """SELECT review_id, substr(product_title, 1, 60) AS source_label, rating,
        CASE WHEN length(text) > 220 THEN concat(substr(text, 1, 220), chr(8230)) ELSE text END AS preview, text
        FROM raw_reviews JOIN products USING (parent_asin)""",
        "raw_reviews", "products",
    ),
    "detect_language": _language(),
    "detect_language_learned": LEARNED,
    "vector_norms": """SELECT vec_id, len(embedding)::INT AS dims,
        round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""",
    "knn_single": _retrieval("SELECT question_id, query_no, review_id, score, rank FROM nearest"),
    "knn_indexed": _retrieval("SELECT question_id, review_id, score, position FROM found"),
    "knn_multi": _retrieval("SELECT question_id, review_id, score, position FROM found"),
    "filter_sentiment": _retrieval(
        f"SELECT {FACTS}, score FROM by_sentiment", BY_SENTIMENT
    ),
    "filter_title_hint": _retrieval(
        f"""SELECT {FACTS}, product_hint, score FROM hits JOIN asked USING (question_id)
        WHERE regexp_matches(product_title, nullif(product_hint, 'src1++('), 'i')"""
    ),
    "soft_filter_3": _retrieval(
        f"SELECT {FACTS}, score FROM soft", BY_SENTIMENT, SOFT_3
    ),
    "soft_filter_20": _retrieval(f"SELECT {FACTS}, score FROM soft", SOFT_20, k=200),
    "rag_hits": _retrieval(
        f"SELECT {FACTS}, number, score, text FROM answer", BY_SENTIMENT, SOFT_3, ANSWER
    ),
    "rag_sources": _retrieval(
        "SELECT question_id, number, product_title, rating, text FROM answer WHERE number <= 3",
        BY_SENTIMENT, SOFT_3, ANSWER,
    ),
    "rag_context": _retrieval(
        f"SELECT question_id, number, {CONTEXT_LINE} AS line FROM answer", BY_SENTIMENT, SOFT_3, ANSWER
    ),
    "rag_prompt": _retrieval(
        f"""SELECT question_id, coalesce(n_hits, 0) AS n_hits,
        CASE WHEN n_hits > 0 THEN {_render(V.ANSWER_PROMPT, question="question", context="context")} END AS prompt,
        CASE WHEN n_hits IS NULL THEN {_text(V.NOTHING_FOUND)} END AS answer,
        CASE WHEN n_hits > 0 THEN {_text(V.ANSWER_SYSTEM)} END AS system
        FROM asked LEFT JOIN (SELECT question_id, count(*) AS n_hits,
          string_agg({CONTEXT_LINE}, {_text(V.CONTEXT_SEPARATOR)} ORDER BY number) AS context
          FROM answer GROUP BY 1) c USING (question_id)""",
        BY_SENTIMENT, SOFT_3, ANSWER, corpus="mild_corpus",
    ),
    "proscons_candidates": _retrieval(
        f"SELECT {FACTS}, number, score, text FROM topic", SOFT_20, TOPIC, k=200
    ),
    "proscons_gate": _retrieval(
        "SELECT question_id, sentiment, number, review_id FROM gated", SOFT_20, TOPIC, k=200
    ),
    "proscons_prompt": _retrieval(
        _pros_cons("gated", "question_id", "question", "number"), SOFT_20, TOPIC, k=200
    ),
    "product_prompt": with_views(f"SELECT * FROM ({PRODUCT_PROMPT})", "text_reviews"),
    "compare_prompt": with_views(f"SELECT * FROM ({COMPARE_PROMPT})", "text_reviews"),
    "rewrite_prompt": with_views(
        f"""SELECT *, {_text(V.REWRITE_SYSTEM)} AS system FROM (
        SELECT question_id, 'question' AS kind, {_render(V.REWRITE_PROMPT, question="question")} AS prompt
        FROM questions UNION ALL
        SELECT question_id, 'topic', {_render(V.REWRITE_PROMPT, question="concat('pros and cons of ', question)")}
        FROM questions) r""",
        "questions",
    ),
    "parse_query_plan": f"SELECT * REPLACE (array_to_string(search_queries, '|') AS search_queries) FROM ({PLANS})",
    "plan_variants": f"""SELECT plan_id AS question_id, (n - 1)::INT AS query_no, search_queries[n] AS query
        FROM ({PLANS}) p, range(1, 4) r(n) WHERE n <= len(search_queries)""",
    "parse_proscons": PARSED_PROS_CONS,
    "parse_compare": PARSED_COMPARE,
    "question_clean": f"""SELECT conv_id, turn, {STRIP.format("text")} AS question
        FROM conversations WHERE role <> 'system' AND {STRIP.format("text")} <> ''""",
    "session_last5": """SELECT * FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""",
    "session_append": """SELECT * FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT conv_id, max(turn) + 1, 'user', concat('turn ', max(turn) + 1)
          FROM conversations GROUP BY 1) t
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""",
}
