import pytest
from samples import no_docs, odd_docs

from opinarium.llm import mixing


def water(sizes, weights):
    """Shares by weight, full sources taken out one round after the other."""
    left, target = dict(sizes), {}
    total = sum(sizes.values())
    while left:
        share = {s: total * weights[s] / sum(weights[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 3 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * sizes[s]
            total -= target[s]
            del left[s]
    return target


def mixed(spark, sizes, per=40):
    rows = [(i * 100 + j, " ".join("w" * 1 for _ in range(n // per + (j < n % per))), s) for i, (s, n) in enumerate(sizes.items()) for j in range(per)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    return docs, mixing.mix_sources(docs).collect()


@pytest.mark.parametrize("sizes", [
    {"a": 4000, "b": 4000, "c": 4000, "d": 400, None: 8000},
    {"a": 40, "b": 50_000, "c": 80},
    {"only": 700},
])
def test_targets_and_taken_words(spark, sizes):
    docs, rows = mixed(spark, sizes)
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for s, n in sizes.items():
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {n}
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.size * r.copies for r in own) - want[s]) <= max(r.size for r in own)
        assert max(r.copies for r in own) <= 3 and max(r.copies for r in own) - min(r.copies for r in own) <= 1
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in mixing.mix_sources(docs.repartition(7)).collect())
    repeated = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in repeated} == {r.doc_id: r.copies for r in rows if r.copies}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert mixing.mix_sources(docs).count() == docs.count()
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0
    blank = docs.filter("doc_id in (0, 1, 2)")
    assert {(r.target, r.size) for r in mixing.mix_sources(blank).collect()} == {(0.0, 0)}
