"""Views that give the test tables the shape of reviews.

The same SQL text runs in Spark and in DuckDB; ``{name}`` marks a table or another view.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

KEY = ("review_id",)

# Reviews with ratings, prices, images and days; some of each are null and many products
# share a title. The id orders the rows by order, line, part, supplier and quantity, which together are unique.
REVIEWS = """
SELECT (((l_orderkey * 8 + l_linenumber) * 131072 + l_partkey) * 4096 + l_suppkey) * 64
           + CAST(l_quantity AS BIGINT) AS review_id,
       l_orderkey AS order_id, l_partkey AS product_id, p_name AS product_title,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END AS price,
       CASE WHEN l_partkey % 7 = 0 THEN NULL
            ELSE concat('img/', CAST(l_partkey AS STRING)) END AS image_url,
       rating,
       CASE WHEN rating <= 2 THEN 'neg' WHEN rating >= 4 THEN 'pos'
            WHEN rating = 3 THEN 'neu' END AS sentiment,
       CAST(l_shipdate AS DATE) AS review_date
FROM (SELECT *, CASE WHEN l_orderkey % 97 = 0 THEN NULL
                     ELSE CAST(floor((l_quantity - 1) / 10) AS INT) + 1 END AS rating
      FROM {lineitem}) x
JOIN {part} ON l_partkey = p_partkey
"""

REVIEWS_WITH_USERS = """
SELECT r.*, o_custkey AS user_id FROM {rv} r JOIN {orders} ON order_id = o_orderkey
"""

CORPUS = """
SELECT doc_id AS review_id, embedding, source AS product_title, lang, text,
       CAST(1 + doc_id % 5 AS INT) AS rating,
       CASE WHEN doc_id % 5 <= 1 THEN 'neg' WHEN doc_id % 5 = 2 THEN 'neu'
            ELSE 'pos' END AS sentiment
FROM {documents} JOIN {embeddings} ON doc_id = vec_id
"""

# All documents as reviews, rated by their length, so that a title has every rating.
TEXT_REVIEWS = """
SELECT doc_id AS review_id, source AS product_title, text, CAST(1 + n_chars % 5 AS INT) AS rating,
       CASE WHEN n_chars % 5 <= 1 THEN 'neg' WHEN n_chars % 5 = 2 THEN 'neu' ELSE 'pos' END AS sentiment
FROM {documents}
"""

# The corpus with so few negative reviews that some questions find none.
MILD_CORPUS = """
SELECT review_id, embedding, product_title, lang, text, rating,
       CASE WHEN review_id % 97 = 0 THEN 'neg' ELSE 'pos' END AS sentiment
FROM {corpus}
"""

# Every stored vector serves as a query; three in a row are the variants of one question.
QUERIES = """
SELECT CAST(floor(vec_id / 3.0) AS BIGINT) AS question_id, CAST(vec_id % 3 AS INT) AS query_no,
       embedding AS query_vec
FROM {embeddings}
"""

# The question's text is the source of a document, so it can serve as a title hint.
QUESTIONS = """
SELECT question_id, source AS question,
       CASE question_id % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'pos' ELSE 'neg' END AS sentiment,
       CASE WHEN question_id % 8 = 5 THEN 'zzz' WHEN question_id % 8 = 3 THEN 'src1++('
            WHEN question_id % 2 = 0 THEN 'SRC1' END AS product_hint
FROM (SELECT DISTINCT question_id FROM {queries}) q JOIN {documents} ON doc_id = question_id
"""

RAW_PLANS = """
SELECT p_partkey AS plan_id, p_name AS question,
       CASE WHEN p_partkey % 10 = 9 THEN 'not json'
            WHEN p_partkey % 10 = 8 THEN concat('```json', chr(10), '{{"search_queries":[],"sentiment":"pos",',
                                                '"product_hint":null}}', chr(10), '```')
            WHEN p_partkey % 10 = 7 THEN concat('{{"search_queries":"', p_name, '","sentiment":"neg","product_hint":"',
                                                p_brand, '"}}')
            WHEN p_partkey % 10 = 6 THEN concat('{{"search_queries":["', p_name, '","', p_type, '"],"sentiment":["x"],',
                                                '"product_hint":"', p_brand, '"}}')
            ELSE concat('{{"search_queries":["', p_name, '","', p_type, '"],"sentiment":"neg",',
                        '"product_hint":"', p_brand, '"}}') END AS raw
FROM {part}
"""

RAW_REVIEWS = """
SELECT doc_id AS review_id, n_chars % 50 AS user_id, n_chars % 150 AS parent_asin, text, lang,
       CAST(1 + doc_id % 5 AS INT) AS rating, 1262304000000 + doc_id * 86400000 AS ts_ms
FROM {documents}
"""

PRODUCTS = """
SELECT p_partkey AS parent_asin, p_name AS product_title, p_retailprice AS price, p_brand AS brand
FROM {part}
"""

PROS_CONS_TEXTS = """
SELECT p_partkey AS text_id,
       concat('Intro', chr(10), 'PROS', chr(10), '1. ', p_name, ' - ', p_type, chr(10),
              '2. ', p_brand, chr(10), 'CONS', chr(10), '1. size ', CAST(p_size AS STRING),
              chr(10), 'closing note') AS txt
FROM {part}
"""

COMPARE_TEXTS = """
SELECT p_partkey AS text_id,
       concat('**Where A Wins:** not kept', chr(10), '1. ', p_name, chr(10), '- **', p_type, '** fits',
              chr(10), chr(10), '**Where B Wins:**', chr(10), '2) ', p_brand, chr(10),
              '**Verdict:** Buy ', p_name, '.', chr(10), '- Size ', CAST(p_size AS STRING), ' matters.') AS txt
FROM {part}
"""

# Neighbouring parts; titles repeat, so some pairs name one title twice.
PAIRS = """
SELECT DISTINCT a.p_name AS product_a, b.p_name AS product_b
FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1
"""

VIEWS = {
    "rv": REVIEWS,
    "rv_users": REVIEWS_WITH_USERS,
    "corpus": CORPUS,
    "text_reviews": TEXT_REVIEWS,
    "mild_corpus": MILD_CORPUS,
    "queries": QUERIES,
    "questions": QUESTIONS,
    "raw_plans": RAW_PLANS,
    "raw_reviews": RAW_REVIEWS,
    "products": PRODUCTS,
    "pros_cons_texts": PROS_CONS_TEXTS,
    "compare_texts": COMPARE_TEXTS,
    "pairs": PAIRS,
}


def inputs(view: str) -> list[str]:
    """Tables and views a view reads."""
    return sorted({name for _, name, _, _ in Formatter().parse(VIEWS[view]) if name})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the data set, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{source: load(spark, sf_dir, source) for source in inputs(name)})


def with_views(sql: str, *names: str) -> str:
    """Prefix a statement with the views it reads, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for source in inputs(name):
                add(source)
            ordered.append(name)

    for name in names:
        add(name)
    heads = [f"{name} AS ({VIEWS[name].format(**{i: i for i in inputs(name)}).strip()})" for name in ordered]
    return f"WITH {', '.join(heads)} {sql}" if heads else sql
