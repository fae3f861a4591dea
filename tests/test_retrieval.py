import pytest
from pyspark.sql import functions as F

import opinarium as op
from catalog.views import load
from opinarium.operators import search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return [load(spark, SF, name) for name in ("corpus", "queries", "questions")]


def rows(df):
    return sorted(tuple(sorted(r.asDict().items(), key=str)) for r in df.collect())


@pytest.mark.parametrize("job", [op.answer_hits, op.topic_candidates])
def test_blocks_do_not_change_results(spark, inputs, monkeypatch, job):
    whole = rows(job(*inputs, k=9))
    monkeypatch.setattr(search, "MATRIX_BYTES", 8 * 64 * 250)
    assert len(search.query_blocks(inputs[1], 9)) > 1
    assert rows(job(*inputs, k=9)) == whole


def test_every_hit_respects_its_plan(inputs):
    corpus, queries, questions = inputs
    hits = op.answer_hits(*inputs).join(questions.select("question_id", F.col("sentiment").alias("asked")), "question_id")
    assert hits.filter("asked in ('pos', 'neg') and sentiment <> asked").count() == 0
    sizes = hits.groupBy("question_id").agg(F.count("*").alias("n"), F.max("number").alias("last")).collect()
    assert all(r.n == r["last"] <= 8 for r in sizes)


def test_merged_score_is_at_least_each_variants(inputs):
    corpus, queries, _ = inputs
    single, merged = op.nearest(corpus, queries, 10), op.retrieve(corpus, queries, 10)
    both = single.join(merged.select("question_id", "review_id", F.col("score").alias("best")), ["question_id", "review_id"])
    assert both.filter("best < score").count() == 0 and both.count() == single.count()


def test_only_three_variants_are_used(spark, inputs):
    corpus, queries, _ = inputs
    more = queries.unionByName(queries.withColumn("query_no", F.col("query_no") + 3))
    assert rows(op.retrieve(corpus, more, 5)) == rows(op.retrieve(corpus, queries, 5))


def test_no_hits_means_the_fixed_answer(spark, inputs):
    corpus, queries, questions = inputs
    only_negative = corpus.withColumn("sentiment", F.lit("neg"))
    prompts = op.answer_prompts(op.answer_hits(only_negative, queries, questions), questions)
    asked = prompts.join(questions.select("question_id", "sentiment"), "question_id")
    assert asked.filter("sentiment = 'pos' and (n_hits > 0 or answer is null)").count() == 0
    assert asked.filter("sentiment <> 'pos' and (n_hits = 0 or prompt is null)").count() == 0
