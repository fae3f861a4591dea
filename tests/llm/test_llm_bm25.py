import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import no_docs, odd_docs, prose

from opinarium.llm import bm25


def brute(docs, query, k):
    texts = [(i, Counter((t or "").encode().lower().split())) for i, t in docs if i is not None]
    spread = Counter(w for _, t in texts for w in t)
    mean = sum(sum(t.values()) for _, t in texts) / len(texts)
    scores = []
    for i, t in texts:
        norm = 1.2 * (0.25 + 0.75 * sum(t.values()) / mean)
        score = sum(
            n * math.log(1 + (len(texts) - spread[w] + 0.5) / (spread[w] + 0.5)) * t[w] * 2.2 / (t[w] + norm)
            for w, n in Counter((query or "").encode().lower().split()).items() if w in t
        )
        if score > 0:
            scores.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(scores)[:k]]


def compare(docs, k, every=1):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    queries = docs.filter(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "text").distinct()
    got = {}
    for r in bm25.top_k(docs, queries, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q in queries.collect():
        want = brute(rows, q.text, k)
        have = got.get(q.query_id, [])
        assert [s for _, s in have] == pytest.approx([s for _, s in want])
        assert sorted(i for i, _ in have) == sorted(i for i, _ in want) or len(want) == k
    return got


def test_against_brute_force_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BYTES", 20_000)  # several blocks of queries
    rows = [(i, prose(i % 40 + i // 200, 20 + i % 90)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)
    compare(docs, 5, every=20)


def test_odd_rows(spark):
    got = compare(odd_docs(spark), 4)
    assert 1 not in got and 0 not in got and got[3][0][0] == 13 and got[10][0][0] == 9
    queries = odd_docs(spark).select(F.col("doc_id").alias("query_id"), "text").filter("doc_id = 6").distinct()
    assert bm25.top_k(no_docs(spark), queries, 3).count() == 0
    assert bm25.top_k(odd_docs(spark), queries.filter("false"), 3).count() == 0


def test_skips_blocks_that_cannot_reach_the_bar():
    rows = [bm25.terms_of(prose(i, 50)) for i in range(2000)]
    names = ("docs", "lengths", "terms", "offsets", "postings", "times")
    shard = bm25.Shard(dict(zip(names, bm25._shard(list(range(2000)), rows)[3:])), 50.0)
    import numpy as np

    own = rows[77]
    terms = np.array(sorted(own), np.uint64)
    weights = np.ones(len(terms))
    docs, scores = shard.search(terms, weights, 3, 0.0)
    assert shard.search(terms, weights, 3, scores.max() + 1)[0].size == 0


def test_texts_of_one_id_are_one_query(spark):
    rows = [(i, prose(i % 30, 15 + i % 20) + (" everywhere" if i % 2 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    queries = [(7, "everywhere " + prose(3, 9)), (7, "everywhere " + prose(4, 9)), (7, None), (8, prose(5, 4)), (8, prose(5, 4)), (None, "everywhere")]
    asked = spark.createDataFrame(queries, "query_id bigint, text string").repartition(3)
    got = {}
    for r in bm25.top_k(docs, asked, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, pytest.approx(r.score)))
    merged = {i: " ".join(t for j, t in queries if i == j and t) for i in (7, 8)}
    assert got == {i: brute(rows, text, 6) for i, text in merged.items()}


@pytest.mark.parametrize("columns", [0, 3, 512])
def test_frequent_and_rare_terms_score_alike(spark, monkeypatch, columns):
    monkeypatch.setattr(bm25, "COLUMNS", columns)
    monkeypatch.setattr(bm25, "TILE", 3)
    monkeypatch.setattr(bm25, "BLOCK", 8)
    rows = [(i, prose(i % 70, 10 + i % 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    compare(docs, 5, every=15)


def test_a_worker_gets_one_shard_at_a_time(spark, monkeypatch):
    """Ten shards of a partition used to come as one batch."""
    from opinarium.llm.tables import small

    def alone(batches, rows=500):
        for batch in batches:
            assert rows > 1 or batch.num_rows == 1
            yield from small([batch], rows)

    monkeypatch.setattr(bm25, "small", alone)
    monkeypatch.setattr(bm25, "SHARD_DOCS", 20)
    docs = spark.createDataFrame([(i, prose(i % 70, 10 + i % 40)) for i in range(200)], "doc_id bigint, text string").coalesce(1)
    compare(docs, 5, every=20)


def test_long_shards_stay_small(monkeypatch):
    import tracemalloc

    import numpy as np

    texts = [bm25.terms_of(prose(i, 60)) for i in range(3000)]
    row = dict(zip(bm25.SHARD_FIELDS, bm25._shard(list(range(3000)), texts)[3:]))
    terms = np.sort(np.array(list(set().union(*texts)), np.uint64))
    tile = bm25.Tile(np.array([0, len(terms)]), terms, np.ones(len(terms)))
    found = []
    for cells, added in ((1 << 40, 1 << 40), (3000 * 4, 5000)):
        monkeypatch.setattr(bm25, "DENSE_CELLS", cells)
        monkeypatch.setattr(bm25, "ADDED", added)
        tracemalloc.start()
        shard = bm25.Shard(row, 60.0)
        found.append((shard.search_tile(tile, 10, np.zeros(1)), shard.dense.nbytes, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    (want, wide, peak), (got, narrow, lower) = found
    assert got[1].tolist() == want[1].tolist() and got[2] == pytest.approx(want[2])
    assert narrow <= 3000 * 4 * 8 < wide and lower < peak


def test_only_documents_near_the_bar_are_scored_in_full():
    """All documents of a visited block used to be."""
    import numpy as np

    class Counted(np.ndarray):
        rows = 0

        def __getitem__(self, at):
            found = super().__getitem__(at)
            Counted.rows += len(found)
            return found

    texts = [bm25.terms_of(prose(i, 50)) for i in range(2000)]
    shard = bm25.Shard(dict(zip(bm25.SHARD_FIELDS, bm25._shard(list(range(2000)), texts)[3:])), 50.0)
    terms = np.array(sorted(texts[77]), np.uint64)
    norm = [1.2 * (0.25 + 0.75 * sum(t.values()) / 50.0) for t in texts]
    sums = [sum(t[w] * 2.2 / (t[w] + norm[i]) for w in texts[77] if w in t) for i, t in enumerate(texts)]
    want = sorted((-round(s, 9), i) for i, s in enumerate(sums) if s)[:5]
    shard.dense = shard.dense.view(Counted)
    docs, scores = shard.search(terms, np.ones(len(terms)), 5, 0.0)
    assert sorted(docs.tolist()) == sorted(i for _, i in want) and scores.tolist() == pytest.approx([-s for s, _ in want])
    assert len(docs) <= Counted.rows < 100


def test_postings_take_few_bytes_and_long_counts_stay_whole(spark):
    """Each posting used to take eight bytes of a row."""
    rows = [(i, prose(i % 70, 10 + i % 40)) for i in range(300)]
    name, n, total, *arrays = bm25._shard(*map(list, zip(*((i, bm25.terms_of(t)) for i, t in rows))))
    shard = dict(zip(bm25.SHARD_FIELDS, arrays))
    postings = sum(len(bm25.terms_of(t)) for _, t in rows)
    assert (len(shard["postings"]), len(shard["times"])) == (2 * postings, postings)
    rows += [(300, "often " * 70_000), (301, "often seldom"), (302, "often " * 300)]
    compare(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), 5, every=100)


def test_queries_of_other_words_find_nothing_and_cost_nothing():
    import numpy as np

    texts = [bm25.terms_of(prose(i, 50)) for i in range(200)]
    shard = bm25.Shard(dict(zip(bm25.SHARD_FIELDS, bm25._shard(list(range(200)), texts)[3:])), 50.0)
    strange = np.array(sorted(bm25.terms_of("qqq xxx zzz")), np.uint64)
    assert shard.find(strange).tolist() == [-1] * 3
    own = np.array(sorted(texts[5]), np.uint64)
    tile = bm25.Tile(np.array([0, 3, 3 + len(own)]), np.r_[strange, own], np.ones(3 + len(own)))
    query, _, scores = shard.search_tile(tile, 4, np.zeros(2))
    assert set(query.tolist()) == {1} and (scores > 0).all()
    numbers = np.arange(3 + len(own))
    again = shard.search_tile(bm25.Tile(tile.offsets, numbers, tile.weights), 4, np.zeros(2), shard.find(tile.terms)[numbers])
    assert again[2].tolist() == scores.tolist()


def test_few_texts_go_to_a_worker_at_once(spark, monkeypatch):
    """All texts of a partition, up to 10,000, used to come as one batch."""
    from opinarium.llm.tables import small

    def few(batches, rows=500):
        for batch in batches:
            assert batch.num_rows <= 200
            yield from small([batch], rows)

    monkeypatch.setattr(bm25, "small", few)
    before = spark.conf.get(bm25.BATCH_ROWS)
    docs = spark.createDataFrame([(i, prose(i % 90, 10 + i % 40)) for i in range(700)], "doc_id bigint, text string").coalesce(1)
    compare(docs, 5, every=50)
    assert spark.conf.get(bm25.BATCH_ROWS) == before
