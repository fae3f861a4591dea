"""What every registered query's plan must and must not contain."""

import re

import pytest

from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
WRITES = {"sink_roundtrip", "marts_roundtrip", "ingest_clean"}
BY_ID = {"product_image", "top_products", "top_products_40", "batches_top_products", "product_drilldown", "leaderboard_stats"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoopJoin|EvalPython|InPandas|PythonUDF", plan)
    assert "MapInArrow" not in plan  # searches have stored their hits
    if name in BY_ID:
        assert "SortAggregate" not in plan
    if name in {"session_last5", "session_append"}:
        assert plan.count("Exchange hash") <= 1 + (name == "session_append")
    # No window without a partition: its rows would all meet in one task.
    for window in re.findall(r"Window(?:GroupLimit)? \[.*", plan):
        assert "windowspecdefinition" not in window or re.search(r"windowspecdefinition\(\w+#\d+L?, ", window)
    if "Exchange SinglePartition" in plan:
        assert name in {
            "kpi_overview", "kpi_display", "kpi_distinct_approx", "sentiment_mix", "chart_context", "scan_vectors",
            "trend_1y", "trend_5y",
        }


def test_texts_stay_out_of_the_search_for_copies(spark):
    """With broadcasts off, texts move for the last anti join only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["docs_dedupe"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    moved = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(doc_id" in line]
    assert "LeftAnti" in plan and len(moved) == 1
    below = "\n".join(lines[moved[0] + 3 :])
    assert "Exchange hashpartitioning(text" not in below and "sha2" in below


def test_prompts_move_cut_texts(spark):
    """The gate's window holds the characters that a prompt shows, not whole texts."""
    plan = QUERIES["proscons_prompt"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "substring(text" in plan[plan.index("Window") :]


def test_cut_candidates_are_the_same(spark):
    from pyspark.sql import functions as F

    import opinarium as op
    from catalog.views import load

    corpus, queries, questions = (load(spark, SF, name) for name in ("corpus", "queries", "questions"))
    whole = op.topic_candidates(corpus, queries, questions).withColumn("text", F.substring("text", 1, 9))
    cut = op.topic_candidates(corpus, queries, questions, chars=9)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) != []
