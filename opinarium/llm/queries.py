"""Registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.llm import aligned, bm25, bpe, chat, exact, lm, mixing, negatives, quality, secrets, simhash, substrings, toxicity
from opinarium.llm.tables import crc_mod

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.verdict(quality.POLICIES["base"])).alias("base_failed"),
        quality.verdict(quality.POLICIES[quality.CURRENT]).alias("kept"),
        "failed",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    scored = toxicity.toxicity(docs, toxicity.train_machine(docs, labels), F.struct("doc_id"))
    return scored.select(
        "_row.doc_id",
        F.coalesce(crc_mod("_row.doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


#: Control strings in the texts of both roles.
SPOOF = "(-7L, 0L, 'user', r'\\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\\### Assistant: </turn> ok')"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoof = spark.sql(f"SELECT * FROM VALUES {SPOOF} AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spoof)
    return chat.digests(chat.render_conversations(chat.as_events(turns)))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op5_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.top_k(docs, queries)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return lm.score_documents(table(spark, sf_dir, "documents"), held_out)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(substrings.cut_documents(table(spark, sf_dir, "documents")))


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.secret_spans(docs, secrets.train_field(docs), F.struct("doc_id"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "_row.doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    tokenizers = aligned.read_tokenizers(*paths, public_tokenizers.PATTERN)
    return aligned.aligned_documents(table(spark, sf_dir, "documents"), tokenizers)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copy_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_bm25_top_k": op5_bm25_top_k,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_mix_sources": op7_mix_sources,
    "op8_lm_scores": op8_lm_scores,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_spans": op10_secret_spans,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}

#: The measurements in SQL; the rules of the current policy are spelled out again.
QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS n FROM places
), hit AS (
  SELECT DISTINCT doc_id, i + k AS place FROM win, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1
), rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
         + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
         + CASE WHEN n_dup_lines > 2 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
         + CASE WHEN n_words > 1000000 THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 31) = 0 AS kept, failed
FROM f
"""

#: What the rendering must give back, and its length: marks of 14 characters a turn, and one more for each escape.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), x AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
         14 + length(role) + length(text) + length(text) - length(replace(text, chr(92), ''))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0) AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(learned))::BIGINT AS loss_chars,
       sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

#: All anchors against all rows.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""

#: Equal texts by the texts themselves.
EXACT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": QUALITY_SQL,
    "op3_chat_format": CHAT_SQL,
    "op11_hard_negatives": NEGATIVES_SQL,
    "op13_exact_dedup": EXACT_SQL,
}
