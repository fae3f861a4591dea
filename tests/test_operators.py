import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinarium.operators import search
from opinarium.operators.filters import sentiment_allowed, soft_filter, title_matches
from opinarium.operators.ranking import first_n, first_n_per_group, hash_sample, key_cutoff
from opinarium.operators.rolling import rolling_mean


def day(text):
    return datetime.date.fromisoformat(text)


# --- ranking ---------------------------------------------------------------------


@pytest.mark.parametrize("lanes", [1, 4, 16])
def test_first_n_with_a_hot_group(spark, lanes):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", *"abc"]), i) for i in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(13)
    got = {(r.g, r.rank, r.k) for r in first_n_per_group(df, ["g"], [F.col("k")], 5, lanes=lanes).collect()}
    want = set()
    for g in {g for g, _ in rows}:
        want |= {(g, i + 1, k) for i, k in enumerate(sorted(k for h, k in rows if h == g)[:5])}
    assert got == want


def test_first_n_per_group_cuts_before_each_exchange(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    for lanes, exchanges in ((16, 2), (1, 1)):
        taken = first_n_per_group(df, ["g"], [F.col("id")], 2, lanes=lanes)
        plan = taken._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 * exchanges
        assert plan.count("Exchange hashpartitioning") == exchanges


@pytest.mark.parametrize("n", [1, 7, 4096, 5000, 20_000])
def test_cutoff_is_the_nth_key(spark, n):
    rng = random.Random(n)
    keys = sorted(rng.sample(range(-(10**15), 10**15), 6000))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    cutoff = key_cutoff(df, "k", n)
    assert cutoff is None if n >= len(keys) else sum(k <= cutoff for k in keys) == n
    assert sorted(r.k for r in first_n(df, "k", n).collect()) == keys[:n]


def test_cutoff_with_repeated_keys(spark):
    df = spark.createDataFrame([(5,)] * 50 + [(9,)] * 50, "k bigint")
    assert key_cutoff(df, "k", 10) == 5
    assert key_cutoff(df, "k", 60) == 9


def test_null_keys_are_left_out_on_both_sides_of_n(spark):
    df = spark.createDataFrame([(k,) for k in (None, 1, -(2**63), 2**63 - 1, None, 7)], "k bigint")
    assert sorted(r.k for r in first_n(df, "k", 2).collect()) == [-(2**63), 1]
    assert sorted(r.k for r in first_n(df, "k", 50).collect()) == [-(2**63), 1, 7, 2**63 - 1]


def test_first_n_is_a_pushed_filter(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    taken = first_n(spark.read.parquet(str(tmp_path / "t")), "id", 10)
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,9)" in plan and "Exchange" not in plan and "Sort" not in plan


def test_sample_is_reproducible_and_exact_in_size(spark):
    df = spark.range(3000).withColumn("v", F.col("id") * 2)
    one = {r.id for r in hash_sample(df, ["id"], 100).collect()}
    two = {r.id for r in hash_sample(df.repartition(11), ["id"], 100).collect()}
    assert one == two and len(one) == 100
    assert hash_sample(df, ["id"], 5000).count() == 3000


# --- rolling ---------------------------------------------------------------------


def test_rolling_uses_present_days_only(spark):
    rows = [("2020-01-01", 1), ("2020-01-30", 2), ("2020-01-31", 3), ("2020-02-29", 7)]
    df = spark.createDataFrame([(day(d), v) for d, v in rows], "date date, v bigint")
    got = {str(r.date): r.v for r in rolling_mean(df, ["v"], 30).collect()}
    assert got == {"2020-01-01": 1.0, "2020-01-30": 1.5, "2020-01-31": 2.5, "2020-02-29": 5.0}


def test_rolling_across_blocks_equals_one_window(spark):
    rng = random.Random(1)
    start = day("1966-03-01")
    days = [start + datetime.timedelta(days=i) for i in range(3000) if rng.random() < 0.7]
    rows = [(d, rng.randrange(100)) for d in days]
    df = spark.createDataFrame(rows, "date date, v bigint")
    got = {r.date: r.v for r in rolling_mean(df, ["v"], 30).collect()}
    assert len(got) == len(rows)
    for d in days:
        inside = [v for e, v in rows if 0 <= (d - e).days < 30]
        assert got[d] == pytest.approx(sum(inside) / len(inside))


# --- filters ---------------------------------------------------------------------


def _hits(spark, matching, total=10):
    rows = [(1, i, "src1" if i < matching else "other") for i in range(total)]
    return spark.createDataFrame(rows, "question_id bigint, position int, product_title string")


@pytest.mark.parametrize("matching, kept", [(0, 10), (2, 10), (3, 3), (10, 10)])
def test_soft_filter(spark, matching, kept):
    flag = title_matches(F.col("product_title"), F.lit("SRC"))
    assert soft_filter(_hits(spark, matching), flag, F.lit(True), 3, ["question_id"]).count() == kept


def test_soft_filter_without_hint_keeps_all(spark):
    flag = title_matches(F.col("product_title"), F.lit(None).cast("string"))
    assert soft_filter(_hits(spark, 5), flag, F.lit(False), 3, ["question_id"]).count() == 10


def test_title_match(spark):
    df = spark.createDataFrame([("src1",), ("xsrc10",), ("SRC1",), (None,), ("s.c1",)], "t string")
    match = [r[0] for r in df.select(title_matches(F.col("t"), F.lit("s.c1"))).collect()]
    assert match == [True, True, True, False, True]
    match = [r[0] for r in df.select(title_matches(F.col("t"), F.lit("S.C1"), "literal")).collect()]
    assert match == [False, False, False, False, True]


def test_sentiment_filter(spark):
    rows = [("pos", "pos"), ("neg", "pos"), (None, "pos"), ("neg", "any"), ("neg", "neu"), (None, None)]
    df = spark.createDataFrame(rows, "s string, w string")
    got = [r[0] for r in df.select(sentiment_allowed(F.col("s"), F.col("w"))).collect()]
    assert got == [True, False, False, True, True, True]


# --- search ----------------------------------------------------------------------


def _vectors(spark, rng, rows, dims, copies=0):
    vectors = rng.normal(size=(rows, dims)).astype(np.float32)
    if copies:
        vectors[rng.choice(rows, copies, replace=False)] = vectors[0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors


def _brute(corpus, ids, queries, keys, k):
    scores = np.round(corpus.astype(np.float64) @ queries.astype(np.float64).T, 9)
    rows = []
    for j, (q, v) in enumerate(keys):
        order = sorted(range(len(ids)), key=lambda i: (-scores[i, j], ids[i]))[:k]
        rows += [(q, v, ids[i], rank + 1, scores[i, j]) for rank, i in enumerate(order)]
    return sorted(rows)


def _frames(spark, corpus, ids, queries, keys, parts):
    c = spark.createDataFrame(
        [(i, v.tolist()) for i, v in zip(ids, corpus)], "review_id bigint, embedding array<float>"
    ).repartition(parts)
    q = spark.createDataFrame(
        [(a, b, v.tolist()) for (a, b), v in zip(keys, queries)],
        "question_id bigint, query_no int, query_vec array<float>",
    )
    return c, q


def _got(df):
    return sorted((r.question_id, r.query_no, r.review_id, r["rank"], r.score) for r in df.collect())


@pytest.mark.parametrize("rows, k, parts, copies", [(300, 7, 5, 0), (300, 7, 5, 100), (20, 40, 3, 0), (500, 40, 1, 170)])
def test_top_k_equals_brute_force(spark, monkeypatch, rows, k, parts, copies):
    monkeypatch.setattr(search, "TILE_ROWS", 64)
    monkeypatch.setattr(search, "TILE_QUERIES", 4)
    rng = np.random.default_rng(rows + k)
    corpus, queries = _vectors(spark, rng, rows, 16, copies), _vectors(spark, rng, 11, 16)
    ids = rng.permutation(rows * 3)[:rows].tolist()
    keys = [(i // 3, i % 3) for i in range(11)]
    c, q = _frames(spark, corpus, ids, queries, keys, parts)
    assert _got(search.top_k(c, q, k)) == _brute(corpus, ids, queries, keys, k)


def test_more_queries_than_one_broadcast(spark, monkeypatch):
    monkeypatch.setattr(search, "MATRIX_BYTES", 8 * 16 * 6)
    rng = np.random.default_rng(5)
    corpus, queries = _vectors(spark, rng, 120, 16), _vectors(spark, rng, 30, 16)
    keys = [(i // 3, i % 3) for i in range(30)]
    c, q = _frames(spark, corpus, list(range(120)), queries, keys, 4)
    assert len(search.query_blocks(q, 9)) > 2
    assert _got(search.top_k(c, q, 9)) == _brute(corpus, list(range(120)), queries, keys, 9)


def test_bars_bound_what_many_partitions_send(spark, monkeypatch):
    monkeypatch.setattr(search, "BAR_SLICE", 4)
    rng = np.random.default_rng(6)
    corpus, queries = _vectors(spark, rng, 8000, 8), _vectors(spark, rng, 3, 8)
    keys = [(0, 0), (0, 1), (1, 0)]
    c, q = _frames(spark, corpus, list(range(8000)), queries, keys, 250)
    vectors, arrays = c.select("review_id", "embedding"), search._as_arrays(q)
    bars = search._bars(vectors, arrays, 5)
    scorer = search._scorer(spark.sparkContext.broadcast((*arrays, bars)), 5, 15, 4096, 512, 9)
    sent = vectors.mapInArrow(scorer, search._SCORES).count()
    assert 15 <= sent <= 3 * 5 * 4 * 4  # not 250 partitions x 3 queries x 5
    assert _got(search.top_k(c, q, 5)) == _brute(corpus, list(range(8000)), queries, keys, 5)


def test_top_k_edges(spark):
    rng = np.random.default_rng(2)
    corpus = _vectors(spark, rng, 10, 4)
    c, q = _frames(spark, corpus, list(range(10)), corpus[:2], [(0, 0), (0, 1)], 2)
    assert search.top_k(c, q.filter("question_id > 5"), 3).count() == 0
    assert search.top_k(c.filter("review_id > 50"), q, 3).count() == 0
    assert search.top_k(c.unionByName(c.limit(1).selectExpr("99L review_id", "cast(null as array<float>) embedding")), q, 3).count() == 6


def test_top_k_is_a_prefix_of_the_next(spark):
    rng = np.random.default_rng(8)
    corpus = _vectors(spark, rng, 60, 8, 20)
    c, q = _frames(spark, corpus, list(range(60)), corpus[:3], [(0, 0), (0, 1), (0, 2)], 3)
    assert [r for r in _got(search.top_k(c, q, 6)) if r[3] <= 5] == _got(search.top_k(c, q, 5))


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "question_id bigint, query_no int, rank int, review_id bigint, score double")


def test_merge_keeps_the_best_score(spark):
    ranked = _ranked(spark, [(1, 0, 1, 10, 0.9), (1, 1, 1, 12, 0.7), (1, 1, 2, 10, 0.5)])
    got = [(r.position, r.review_id, r.score) for r in search.merge_variants(ranked).orderBy("position").collect()]
    assert got == [(1, 10, 0.9), (2, 12, 0.7)]


def test_merge_ties_follow_the_variants(spark):
    ranked = _ranked(spark, [(1, 0, 1, 20, 0.9), (1, 1, 1, 10, 0.9)])
    got = [r.review_id for r in search.merge_variants(ranked).orderBy("position").collect()]
    assert got == [20, 10]


def test_corpus_is_not_shuffled_by_search(spark):
    rng = np.random.default_rng(2)
    corpus = _vectors(spark, rng, 10, 4)
    c, q = _frames(spark, corpus, list(range(10)), corpus[:2], [(0, 0), (0, 1)], 2)
    found = search.merge_variants(search.top_k_of_block(c, q, 3))
    hits = search.attach(found, c.withColumn("text", F.lit("t")), ["text"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("MapInArrow") == 1


def _one_group(vectors, n):
    """The first vectors as the queries of a group, three to a question."""
    q = np.arange(n)
    row = {"ids": (q // 3).astype(np.int64).tobytes(), "numbers": (q % 3).astype(np.int32).tobytes(), "vectors": vectors[:n].astype(np.float64).tobytes()}
    return search.Group([row])


def _streamed(vectors, ids, n, k, width=32, rows=300):
    group = _one_group(vectors, n)
    tiles = search._tiles(group.bars, k, width)
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(ids), rows):
            group.add(tiles, vectors[at : at + rows].astype(np.float64), ids[at : at + rows])
    return [tuple(r.values()) for b in group.hits(tiles) for r in b.to_pylist()]


@pytest.mark.parametrize("kind", ["plain", "copies", "close", "long", "odd"])
def test_screening_in_single_precision_misses_no_hit(kind):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(2500, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if kind == "copies":
        vectors[::2] = vectors[0]
    if kind == "close":  # told apart by double precision only
        vectors = vectors[rng.integers(20, size=2500)] + 3e-9 * rng.normal(size=(2500, 16))
    if kind == "long":
        vectors *= 10.0 ** rng.integers(0, 3, size=(2500, 1))
    if kind == "odd":
        vectors[700, 3], vectors[1300, 2], vectors[900], vectors[901] = np.nan, np.inf, 0, 1e200
    ids = rng.permutation(9000)[:2500].astype(np.int64)
    got = _streamed(vectors, ids, 90, 7)
    with np.errstate(invalid="ignore", over="ignore"):
        scores = np.round(vectors @ vectors[:90].T, 9)
    scores = np.where(np.isnan(scores), -np.inf, scores)
    want = []
    for j in range(90):
        order = np.lexsort((ids, -scores[:, j]))[:7]
        want += [(j // 3, j % 3, int(ids[i]), rank + 1) for rank, i in enumerate(order)]
    assert sorted(r[:3] + r[4:] for r in got) == sorted(want)


def test_few_pairs_are_multiplied_in_double_precision_and_sorted(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(20000, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    again, sorts = [], []
    add, pairs, lexsort = search.Best.add, search.Best.add_pairs, np.lexsort
    monkeypatch.setattr(search.Best, "add", lambda self, q, s, i: (again.append(s.size), add(self, q, s, i)))
    monkeypatch.setattr(search.Best, "add_pairs", lambda self, q, s, i: (again.append(s.size), pairs(self, q, s, i)))
    monkeypatch.setattr(np, "lexsort", lambda keys: (sorts.append(len(keys[0])), lexsort(keys))[1])
    assert len(_streamed(vectors, np.arange(20000), 60, 10, rows=1000)) == 600
    assert sum(again) < 60 * 20000 / 8
    assert sum(sorts) < 60 * 10 * 4  # the last order only
