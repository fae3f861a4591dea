import numpy as np
import pytest
from pyspark.sql import functions as F

import opinarium as op
from catalog.views import load
from opinarium.plans import latent

SF = "/root/testdata/sf0.001"


def table(spark, docs, features, model):
    rows = docs.select(latent.hashed_words(F.col("text"), features).alias("w")).collect()
    counts = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        np.add.at(counts[i], r.w, 1)
    counts *= np.log((len(rows) + 1) / ((counts > 0).sum(0) + 1))
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300)


def test_against_a_full_decomposition(spark):
    docs = load(spark, SF, "documents").repartition(7)
    model = op.learn_latent(docs, dims=6, features=256, passes=12)
    x = table(spark, docs, 256, model)
    _, values, right = np.linalg.svd(x, full_matrices=False)
    assert model.singular == pytest.approx(values[:6], rel=1e-3)
    # Directions are unique up to their sign where singular values differ.
    for i in range(3):
        assert abs(model.basis[:, i] @ right[i]) > 0.99
    assert model.basis.T @ model.basis == pytest.approx(np.eye(6), abs=1e-9)


def test_more_passes_lose_less(spark):
    docs = load(spark, SF, "documents")
    kept = [float((op.learn_latent(docs, dims=8, features=256, passes=p).singular ** 2).sum()) for p in (1, 4)]
    assert kept[0] <= kept[1] + 1e-9


def test_lanes_and_partitions_change_nothing(spark):
    docs = load(spark, SF, "documents")
    one, many = (op.learn_latent(docs.repartition(n), dims=4, features=128) for n in (1, 30))
    assert one.singular == pytest.approx(many.singular) and np.abs(one.basis - many.basis).max() < 1e-6


def test_embeddings(spark):
    docs = load(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "zzzqqq zzzqqq", None)], docs.schema)
    model = op.learn_latent(docs, dims=16, features=512)
    got = {r.doc_id: np.array(r.embedding) for r in op.embed_latent(docs.unionByName(odd), model, id_column="doc_id").collect()}
    assert len(got) == docs.count() + 3 and got[-1].tolist() == got[-2].tolist() == [0.0] * 16
    lengths = [np.linalg.norm(v) for i, v in got.items() if i >= 0]
    assert max(lengths) == pytest.approx(1.0, abs=1e-5)
    x = table(spark, docs, 512, model) @ model.basis
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert np.stack([got[i] for i in ids]) == pytest.approx(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), abs=1e-4)
    # Texts of one language lie together.
    lang = {r.doc_id: r.lang for r in docs.collect()}
    same = [got[i] @ got[j] for i in ids[:80] for j in ids[:80] if i < j and lang[i] == lang[j]]
    other = [got[i] @ got[j] for i in ids[:80] for j in ids[:80] if i < j and lang[i] != lang[j]]
    assert np.mean(same) > np.mean(other) + 0.1


def test_no_texts(spark):
    none = load(spark, SF, "documents").filter("doc_id < 0")
    model = op.learn_latent(none, dims=3, features=64)
    assert model.singular.tolist() == [0, 0, 0] and op.embed_latent(none, model, id_column="doc_id").count() == 0
