import math
import re

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

import opinarium as op
from catalog.views import load

SF = "/root/testdata/sf0.001"
TEXTS = ["red red bolt", "Blue bolt, blue gear!", "", "gear 42 gear"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "review_id bigint, text string")


def test_hashed_embedding_by_hand(spark):
    dims = 64
    place = HashingTF(numFeatures=dims)
    words = [[w for w in re.split(r"[^\w]+", t.lower()) if w] for t in TEXTS]
    buckets = [[place.indexOf(w) for w in ws] for ws in words]
    found = {b: sum(b in bs for bs in buckets) for bs in buckets for b in bs}
    got = {r.review_id: np.array(r.embedding) for r in op.embed_hashed(frame(spark), dims=dims).collect()}
    for i, bs in enumerate(buckets):
        want = np.zeros(dims)
        for b in bs:
            want[b] += math.log((len(TEXTS) + 1) / (found[b] + 1))
        want /= np.linalg.norm(want) or 1
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_hashed_embedding_feeds_retrieval(spark):
    corpus = op.embed_hashed(load(spark, SF, "documents"), id_column="doc_id").withColumnRenamed("doc_id", "review_id")
    queries = corpus.filter("review_id < 4").selectExpr("review_id question_id", "0 query_no", "embedding query_vec")
    best = op.nearest(corpus, queries, k=1).collect()
    assert len(best) == 4 and all(r.score == pytest.approx(1.0, abs=1e-6) for r in best)


def test_own_encoder(spark):
    def encoder(texts):
        return [[len(t), 1.0] for t in texts]

    got = {r.review_id: r.embedding for r in op.embed_with(frame(spark), encoder).collect()}
    assert got[2] == [0.0, 1.0] and np.linalg.norm(got[0]) == pytest.approx(1.0)


def test_language_of_documents(spark):
    found = op.detect_language(load(spark, SF, "documents"))
    assert found.filter("detected = lang").count() >= 0.95 * found.count()


def test_no_known_word_no_language(spark):
    df = spark.createDataFrame([("zz 12",), ("Für das Haus",)], "text string")
    assert [r.detected for r in op.detect_language(df).collect()] == [None, "de"]


def test_sessions(spark):
    turns = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 0)], "session_id bigint, turn bigint")
    assert sorted(r.turn for r in op.last_turns(turns).filter("session_id = 1").collect()) == [2, 3, 4, 5, 6]
    more = op.append_turns(turns, spark.createDataFrame([(1, 7), (3, 0)], "session_id bigint, turn bigint"))
    assert sorted((r.session_id, r.turn) for r in more.collect()) == [(1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 0), (3, 0)]


def test_null_text_has_a_zero_vector(spark):
    df = spark.createDataFrame([(1, None), (2, "bolt")], "review_id bigint, text string")
    got = {r.review_id: r.embedding for r in op.embed_hashed(df, dims=16).collect()}
    assert set(got[1]) == {0.0} and len(got) == 2
