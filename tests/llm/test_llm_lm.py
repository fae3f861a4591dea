import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import no_docs, odd_docs, prose

from opinarium.llm import lm
from opinarium.llm.filters import mixed, unmixed


def held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def test_base_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 30)
    docs = odd_docs(spark)
    rows = docs.select("doc_id", "text").collect()
    out = {id_: zlib.crc32(str(id_).encode()) % 7 == 2 if id_ is not None else False for id_, _ in rows}
    tokens = {(r.doc_id, r.text): [*(r.text or "").encode().lower().split(), b""] for r in rows}
    count = Counter(w for r in rows if not out[r.doc_id] for w in tokens[r.doc_id, r.text])
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(r.doc_id), len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4))
        for r in rows for t in [tokens[r.doc_id, r.text]]
    )
    got = lm.score_documents(docs, held()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_the_model_predicts_held_out_texts_better(spark):
    rows = [(i, prose(i % 15, 80)) for i in range(300)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), held()).filter("held_out")
    total = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_quantised_counts(spark):
    docs = spark.createDataFrame([("x y " * 100 + "y x z",), ("z z",)], "text string")
    model, _ = lm.train(docs, log_bits=20)
    scorer = lm.Scorer(model, 2)
    known = scorer.known
    ids = np.array([known[b"x"], known[b"y"]])
    pair = scorer.count(lm._pairs(ids, len(known)))[1:]
    assert 64 <= pair[0] <= 128  # 100 times


def test_a_full_segment_keeps_the_larger_counts():
    assert lm.least_count(np.array([1] * 100 + [8] * 10), 50) == 2
    assert lm.least_count(np.array([1, 2, 3]), 50) == 1
    assert lm.least_count(np.array([4] * 100), 50) == 5


def test_empty(spark):
    assert lm.score_documents(no_docs(spark), held()).count() == 0
    only = lm.score_documents(odd_docs(spark), F.lit(True)).collect()
    assert {r.train_tokens for r in only} == {0} and all(r.n_known == 0 and r.base_score == pytest.approx(0) for r in only)


def test_probabilities_after_a_word_sum_to_one(spark, monkeypatch):
    """All tokens after every token, also where full segments have lost their rare bigrams."""
    monkeypatch.setattr(lm, "VOCABULARY", 120)
    rows = [(i, prose(i % 25, 60)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for log_bits, slack in ((24, 1e-3), (15, 0.6)):
        model, _ = lm.train(docs, log_bits=log_bits)
        scorer = lm.Scorer(model, 400)
        n = len(model.words) + 2
        sums = [scorer.chances(np.full(n, before), np.arange(n)).sum() for before in range(n)]
        assert min(sums) > 1 - 1e-9 and max(sums) < 1 + slack
        assert abs(np.mean(sums) - 1) < slack / 4


def test_texts_with_one_hash_in_common_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_tokens) for r in lm.score_documents(docs, F.lit(False)).collect())
    assert got == [("1", 2), ("1", 3), ("1", 3), ("None", 1), ("None", 3)]


def test_words_outside_the_vocabulary_score_by_their_own_counts(spark):
    """Their class is shared out by exact counts, and its parts, unseen words together being one, sum to 1."""
    texts = ["a " * 50, "a b b b b", "a c c", "a d", "b", "c", "d", "never"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    held_out = F.col("doc_id") > 3
    model, counts = lm.train(docs.filter(~held_out), size=2)
    assert model.words == ["a"]
    score = {r.doc_id: r.score for r in lm.scores(docs, model, counts, 4, held_out).collect()}
    words = {"b": 4, "c": 2, "d": 1, "never": 0}
    chance = {w: 10 ** score[4 + i] for i, w in enumerate(words)}
    for w, n in words.items():
        assert chance[w] / chance["never"] == pytest.approx(n + 1)
    scorer = lm.Scorer(model, 4)
    class_and_end = 10 ** (scorer.score([np.array([1, 2])])[0] - scorer.share)
    assert sum(chance.values()) == pytest.approx(class_and_end)


def test_the_word_before_is_read_back_from_a_bigrams_hash():
    values = np.r_[np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64), np.array([0, 1, 2**32, 2**64 - 1], np.uint64)]
    assert (unmixed(mixed(values)) == values).all()
    ids = np.array([4, 7, 7, 0, 9])
    assert (unmixed(lm._pairs(ids, 8)) >> np.uint64(32)).tolist() == [9, 4, 7, 7, 0]


def test_the_filter_shuffles_hashes_and_counts_only(spark, monkeypatch):
    """The word before each bigram went along, one more column of the widest shuffle."""
    schemas = []
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b")], "doc_id bigint, text string")
    kind = type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *rest: schemas.append(schema) or plain(self, f, schema, *rest))
    packed, mass = lm.bigram_filter(docs, ["a", "b"], 16)
    assert schemas[0] == "hash bigint, n int"
    # After a: b three times (level 2, 2.5). After b: a, another word and the end, once each. After another word, an end: the end, and a twice.
    assert mass.tolist() == [2.5, 3.0, 1.0, 2.5] and packed.any()


@pytest.mark.parametrize("probes, log_bits", [(8, 15), (8, 18), (2, 24)])
def test_bigrams_that_the_filter_has_no_room_for_are_counted(spark, monkeypatch, probes, log_bits):
    """They used to be dropped: all of them at 15 bits, the rare ones of most segments at 18, none at 24."""
    monkeypatch.setattr(lm, "PROBES", probes)
    monkeypatch.setattr(lm, "LOG_BITS", log_bits)
    monkeypatch.setattr(lm.train, "__defaults__", (300, log_bits))
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 150, 100)) for _ in range(300)] + ["w1 w2 " * 40, "w3 w3 w3", "", "w5 w6 w5 w6"]
    rows = [*enumerate(texts), (303, texts[303])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    held_out = F.col("doc_id") % 5 == 0
    train = [t.encode().split() for i, t in rows if i % 5]
    single = Counter(w for t in train for w in [*t, b""])
    pairs = Counter((a, b) for t in train for a, b in zip([b"", *t], [*t, b""]))
    assert min(single.values()) >= 2
    held = {p: 1.5 * 2.0 ** (n.bit_length() - 1) - 0.5 for p, n in pairs.items()}
    mass = Counter()
    for (a, _), n in held.items():
        mass[a] += n
    total = sum(single.values()) + 1  # one for all other words

    def score(text):
        own = text.encode().split()
        steps = zip([b"", *own], [*own, b""])
        return sum(math.log10((held.get((a, b), 0) + 200 * single.get(b, 1) / total) / (mass[a] + 200)) for a, b in steps)

    got = lm.score_documents(docs, held_out).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    off = np.array([r.score - score(by_id[r.doc_id]) for r in got])
    assert off.min() > -1e-6 and np.mean(np.abs(off)) < (0.2 if log_bits == 18 else 1e-6)
