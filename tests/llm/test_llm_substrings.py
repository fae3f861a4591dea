import hashlib
import random
import re

import numpy as np
from samples import no_docs, odd_docs

from opinarium.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, out = {}, {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), doc_id) < doc_id:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def digest(docs, window):
    got = substrings.removal_digests(substrings.cut_documents(docs, window)).collect()
    return got, {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None}


def test_against_brute_force(spark):
    rng = random.Random(1)
    passages = [[f"p{k}{rng.randint(0, 9)}" for _ in range(rng.randint(5, 30))] for k in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 20))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for window in (6, 7, 13):
        assert digest(docs, window)[1] == brute(rows, window)


def test_a_full_filter_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LOG_BITS", 15)
    rows = [(i, " ".join(f"{(i // 3) * 50 + j}" for j in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert digest(docs, 10)[1] == brute(rows, 10)


def test_one_passage_in_most_documents(spark):
    hot = " ".join(f"h{i}" for i in range(60))
    rows = [(i, f"{i} {hot} {i}" if i % 3 else f"only {i}") for i in range(900)]
    got = digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20), 50)[1]
    assert got == brute(rows, 50)


def test_long_copies_cut_at_many_places(spark):
    rng = random.Random(2)
    base = [f"b{rng.randint(0, 60)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base[rng.randint(0, 50) : 400 - rng.randint(0, 50)])
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 3)}"
        rows.append((rng.randint(0, 10**6) * 100 + i, " ".join(words)))
    rows += [(5, "a b " * 200), (3, "a b " * 90), (4, "b a " * 120), (1, "a b " * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for window in (8, 50):
        assert digest(docs, window)[1] == brute(rows, window)


def test_texts_hashed_apart_and_together(spark, monkeypatch):
    rows = [(i, " ".join(f"{(i // 2 + j) % 40}" for j in range(i % 37))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    for many in (1, 100, 10**6):
        monkeypatch.setattr(substrings, "AT_ONCE", many)
        assert digest(docs, 10)[1] == brute(rows, 10)


def test_one_id_with_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "xy")
    rows = [(1, one), (2, f"new {two}"), (2, f"{one} new"), (3, two)]
    got, _ = digest(spark.createDataFrame(rows, "doc_id bigint, text string"), 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 80, 0), (2, 81, 0), (2, 81, 80), (3, 80, 80)]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got, by_id = digest(docs, 50)
    assert len(got) == docs.count()
    assert by_id == brute([(r.doc_id, r.text) for r in docs.collect()], 50) or by_id[6][1] == 0
    assert by_id[10][1] == by_id[10][0] and by_id[0] == (0, 0, hashlib.sha256(b"").hexdigest())
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substrings.cut_documents(no_docs(spark)).count() == 0


def test_rolling_hashes_depend_on_order_only_by_content():
    x = np.random.default_rng(0).integers(0, 2**64, 40, dtype=np.uint64)
    both = np.r_[x, x]
    h = substrings.rolling(both, 10)
    assert (h[:31] == h[40:]).all() and len(np.unique(h[:40])) == 40
    assert (substrings.anchors(both, 10)[:31] == substrings.anchors(both, 10)[40:]).all()
