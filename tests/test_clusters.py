import numpy as np
import pytest
from pyspark.sql import functions as F

import opinarium as op
from opinarium.operators import clusters, search

SCHEMA = "review_id bigint, embedding array<float>"


def clustered(n, dims, centres, spread, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(centres, dims))[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frames(spark, vectors, queries, parts=4):
    c = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    q = spark.createDataFrame(
        [(i // 3, i % 3, v.tolist()) for i, v in enumerate(queries)], "question_id bigint, query_no int, query_vec array<float>"
    )
    return c, q


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 16)
    monkeypatch.setattr(clusters, "PART_ROWS", 200)
    monkeypatch.setattr(search, "TILE_QUERIES", 4)


@pytest.mark.parametrize("n, k, spread", [(900, 7, 0.05), (900, 7, 1.0), (20, 40, 0.3)])
def test_equal_to_the_scan(spark, small_cells, n, k, spread):
    vectors = clustered(n, 8, 12, spread)
    c, q = frames(spark, vectors, np.concatenate([vectors[:5], clustered(8, 8, 12, spread, seed=2)]))
    index = clusters.build_index(c)
    assert index.cells.agg(F.sum("n")).first()[0] == n
    assert rows(clusters.index_top_k(index, q, k)) == rows(search.top_k(c, q, k))


def test_cells_are_skipped(spark, small_cells):
    vectors = clustered(3000, 12, 25, 0.03)
    c, q = frames(spark, vectors, vectors[:9])
    index = clusters.build_index(c)
    use = clusters.index_use(index, q, 5).first()
    assert 0 < use.asked_pairs < 0.2 * use.pairs and use.asked_cells < use.cells
    assert rows(clusters.index_top_k(index, q, 5)) == rows(search.top_k(c, q, 5))


def test_one_vector_in_most_rows(spark, small_cells):
    vectors = clustered(600, 6, 5, 0.1)
    vectors[::3] = vectors[0]
    c, q = frames(spark, vectors, vectors[:4])
    index = clusters.build_index(c)
    assert index.cells.agg(F.max("n")).first()[0] <= 16
    assert rows(clusters.index_top_k(index, q, 9)) == rows(search.top_k(c, q, 9))


def test_more_vectors_later(spark, small_cells, tmp_path):
    vectors = clustered(500, 6, 5, 0.1)
    c, q = frames(spark, vectors, vectors[:4])
    clusters.build_index(c.filter("review_id < 700"), str(tmp_path / "i"))
    index = op.add_to_index(op.open_index(spark, str(tmp_path / "i")), c.filter("review_id >= 700"))
    assert rows(op.index_top_k(index, q, 9)) == rows(search.top_k(c, q, 9))


def test_edges(spark, small_cells):
    vectors = clustered(40, 4, 3, 0.2)
    c, q = frames(spark, vectors, vectors[:2])
    nulls = c.unionByName(spark.createDataFrame([(999, None)], SCHEMA))
    assert rows(clusters.index_top_k(clusters.build_index(nulls), q, 3)) == rows(search.top_k(c, q, 3))
    empty = clusters.build_index(c.filter("review_id < 0"))
    assert rows(clusters.index_top_k(empty, q, 3)) == [] == rows(clusters.index_top_k(clusters.build_index(c), q.filter("query_no > 7"), 3))
    with pytest.raises(ValueError, match="values like the queries"):
        op.index_top_k(clusters.build_index(c), frames(spark, vectors, clustered(2, 5, 2, 0.1))[1], 3)


@pytest.mark.parametrize("parts", [250])
def test_many_partitions(spark, monkeypatch, parts):
    """Every search over a corpus whose batches hold no candidate of most queries, k from 1 up."""
    vectors = clustered(5000, 8, 30, 0.2)
    c, q = frames(spark, vectors, vectors[:6], parts)
    facts = c.withColumns({"product_title": F.lit("t"), "rating": F.lit(5), "sentiment": F.lit("pos"), "text": F.lit("x")})
    facts = facts.withColumn("sentiment", F.when(F.col("review_id") % 2 == 0, "neg").otherwise("pos"))
    questions = spark.createDataFrame([(0, "a", "any", None), (1, "b", "pos", "t")], "question_id bigint, question string, sentiment string, product_hint string")
    index = clusters.build_index(facts)
    for k in (1, 8):
        scan, indexed = rows(op.retrieve(facts, q, k)), rows(op.retrieve(facts, q, k, index=index))
        assert len(scan) >= 2 * k and scan == indexed
        whole = rows(op.retrieve(facts.coalesce(2), q, k))
        assert scan == whole
    for job in (op.answer_hits, op.topic_candidates):
        assert rows(job(facts, q, questions, k=8)) == rows(job(facts, q, questions, k=8, index=index)) != []


@pytest.mark.parametrize("n, k, spread, groups", [(900, 7, 0.05, 5), (700, 40, 1.0, 3), (20, 40, 0.3, 2), (600, 1, 0.3, 1)])
def test_groups_of_queries_find_what_brute_force_finds(spark, small_cells, monkeypatch, n, k, spread, groups):
    """Every vector is a query, of questions with one to three; some vectors are copies of one."""
    monkeypatch.setattr(search, "GRID_QUERIES", 4)
    monkeypatch.setattr(search, "PACK_ROWS", 50)
    monkeypatch.setattr(search, "grid_of", lambda queries, k: (queries.count(), 8, groups))
    vectors = clustered(n, 8, 12, spread)
    vectors[::9] = vectors[0]
    c, q = frames(spark, vectors, vectors)
    scores = np.round(vectors.astype(np.float64) @ vectors.astype(np.float64).T, 9)
    want = sorted(
        (i // 3, i % 3, j * 3, float(scores[i, j]), rank + 1)
        for i in range(n) for rank, j in enumerate(sorted(range(n), key=lambda j: (-scores[i, j], j))[:k])
    )
    for found in (search.top_k(c, q, k), clusters.index_top_k(clusters.build_index(c), q, k)):
        assert rows(found.select("question_id", "query_no", "review_id", "score", "rank")) == want
    merged = search.merge_variants(spark.createDataFrame(want, "question_id bigint, query_no int, review_id bigint, score double, rank int"))
    for index in (None, clusters.build_index(c)):
        assert rows(op.retrieve(c, q, k, index=index).select(*merged.columns)) == rows(merged)


def test_many_queries_send_few_rows(spark, monkeypatch):
    """However many tasks read the vectors, the hits of a group come from one, ``k`` rows a query, and the index has many parts."""
    monkeypatch.setattr(search, "GRID_QUERIES", 100)
    vectors = clustered(3000, 6, 5, 0.3)
    c, q = frames(spark, vectors, vectors[:900], parts=40)
    rows_, dims, groups = search.grid_of(q, 10)
    assert (rows_, dims) == (900, 6) and groups > 1
    assert search.grid_top_k(c, q, groups, 10).count() == 9000
    monkeypatch.setattr(clusters, "PART_ROWS", 200)
    index = clusters.build_index(c)
    assert clusters.grid_index_top_k(index, q, dims, groups, 10).count() == 9000
