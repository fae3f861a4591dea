import hashlib
import re

import pytest
from pyspark.sql import functions as F
from samples import COLUMNS, no_docs, odd_docs, prose

from opinarium.llm import exact


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    """Rows (doc_id, text) to the sorted result; of rows alike in id and text one is kept."""
    groups = {}
    for i, text in rows:
        groups.setdefault(plain(text), []).append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, exact.copy_digests(docs).collect()), key=str)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert exact.copy_digests(no_docs(spark)).collect() == []


@pytest.mark.parametrize("bits", [20, 0])
def test_refinement_changes_no_result(spark, monkeypatch, bits):
    """With one word all keys share 64 bits: more is hashed, nothing else changes."""
    monkeypatch.setattr(exact, "WORD_BITS", bits)
    monkeypatch.setattr(exact, "PREFIX", 8)
    same_start = "x" * 300
    texts = [same_start + str(i % 7) for i in range(40)] + ["hot  copy", "hot\tcopy ", "hot copy"] * 50 + [None, "", " ", "\n"]
    rows = [(i * 37 % 1000, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(docs) == brute(rows)


def test_only_surviving_groups_are_hashed(spark):
    rows = [(1, "one"), (2, "four"), (3, "five"), (4, "same text"), (5, "same  text"), (6, "abc" * 100 + "x"), (7, "abc" * 100 + "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = exact._hashed(docs, F.struct("doc_id")).filter("_full IS NOT NULL")
    assert sorted(r._id for r in hashed.collect()) == [4, 5, 6, 7]


def test_many_copies_and_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_SHARE", 4)
    rows = [(i, "hot" if i % 3 == 0 else prose(i % 60, 20)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert found(docs) == brute(rows)


def test_whole_rows(spark):
    docs = odd_docs(spark)
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns and kept.schema.simpleString() == no_docs(spark).schema.simpleString()
    texts = [plain(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({plain(r.text) for r in docs.collect()})
    assert COLUMNS.startswith("doc_id")
    six = [r for r in kept.collect() if plain(r.text) == plain(prose(1, 200))]
    assert [r.doc_id for r in six] == [6]
