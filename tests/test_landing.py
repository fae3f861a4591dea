import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import opinarium as op
from opinarium.plans import ingest

RAW = "user_id string, parent_asin string, text string, rating int, ts_ms bigint"


def distinct_ids(spark, rows, schema=RAW):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = ingest.with_ids(df)
    again = ingest.with_ids(df.repartition(5))
    assert sorted(got.collect(), key=str) == sorted(again.collect(), key=str)
    return [r.review_id for r in got.collect()], sorted((tuple(r)[:-1] for r in got.select(*df.columns, "review_id").collect()), key=str)


def test_nulls_in_every_position(spark):
    """A value that moves over a null, or that holds what marks a null, is another review."""
    values = [None, "7", "-", "1:7"]
    rows = [(*pick, n, n) for pick in itertools.product(values, repeat=3) for n in (None, 7)]
    ids, kept = distinct_ids(spark, [*rows, *rows[:9]])
    assert len(ids) == len(set(ids)) == len(rows) and kept == sorted(rows, key=str)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(*[st.sampled_from([None, "", "a", "aa", "1:a"])] * 3, *[st.sampled_from([None, 1, 11])] * 2), min_size=1, max_size=40))
def test_nothing_is_lost(spark, rows):
    ids, kept = distinct_ids(spark, rows)
    assert len(set(ids)) == len(ids) and kept == sorted(set(rows), key=str)


def test_rows_that_share_an_id_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ingest, "_id_of", lambda digest: -F.conv(F.substring(digest, 1, 1), 16, 10).cast("bigint") - 1 - F.when(F.length(digest) < 32, 100).otherwise(0))
    rows = [(str(i), "p", "t", i, i) for i in range(12)]
    df = spark.createDataFrame([*rows, *rows[:5]], RAW)
    got = ingest.with_ids(df).collect()
    assert len(got) == 12 and {r.user_id for r in got} == {r[0] for r in rows}


def test_given_ids_stay(spark):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c"), (None, "c"), (None, None)], "review_id bigint, text string")
    got = sorted((r.review_id, r.text) for r in ingest.with_ids(df).filter("review_id >= 0").collect())
    assert got == [(5, "a"), (5, "b")] and ingest.with_ids(df).count() == 4


LINES = [
    ('{"review_id":1,"user_id":"u","parent_asin":"p","text":"t","lang":"en","rating":5.0,"ts_ms":9}', None),
    ('{"user_id":7,"parent_asin":"p","text":true,"rating":4}', None),
    ('{"user_id":"u","rating":4.5}', ["rating: not whole"]),
    ('{"user_id":"u","rating":"5"}', ["rating: string"]),
    ('{"user_id":"u","ts_ms":"soon","rating":[1]}', ["rating: array", "ts_ms: string"]),
    ('{"user_id":"u","ts_ms":1.5}', ["ts_ms: decimal"]),
    ('{"user_id":"u"', ["malformed JSON"]),
    ("not json", ["malformed JSON"]),
    ("[1]", ["no JSON object"]),
    ("3", ["no JSON object"]),
    ("{}", None),
    ('{"other":1}', None),
    ("", None), ("   ", None),
]


def test_every_line_is_typed_or_rejected(spark, tmp_path):
    (tmp_path / "raw.json").write_text("\n".join(line for line, _ in LINES))
    landed = op.split_raw_reviews(spark, str(tmp_path / "raw.json"))
    rejected = {r.record: sorted(r.reasons) for r in landed.rejected.collect()}
    assert rejected == {line: why for line, why in LINES if why}
    assert landed.typed.count() == sum(why is None and bool(line.strip()) for line, why in LINES)
    assert {(r.user_id, r.text, r.rating) for r in landed.typed.collect()} == {("u", "t", 5), ("7", "true", 4), (None, None, None)}


def test_rejects_are_stored(spark, tmp_path):
    good = {"user_id": "u", "parent_asin": "p", "text": "t", "rating": 3, "ts_ms": 1}
    lines = [json.dumps(good | {"rating": r}) for r in (1, 2.0, 2.5)] + ["{"]
    (tmp_path / "raw.json").write_text("\n".join(lines))
    read = op.read_raw_reviews(spark, str(tmp_path / "raw.json"), rejects=str(tmp_path / "bad"))
    assert sorted(r.rating for r in read.collect()) == [1, 2]
    assert sorted(r.record for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted(lines[2:])


def test_rows_of_other_formats(spark, tmp_path):
    df = spark.createDataFrame([("u", "p", "t", "5", "9"), ("u", "p", "t", "4.5", "9"), ("u", None, "t", "x", "soon")],
                               "user_id string, parent_asin string, text string, rating string, ts_ms string")
    df.write.parquet(str(tmp_path / "p"))
    landed = op.split_raw_reviews(spark, str(tmp_path / "p"), "parquet")
    assert sorted(r.reasons for r in landed.rejected.collect()) == [["rating: not whole"], ["rating: string", "ts_ms: string"]]
    assert [(r.rating, r.ts_ms, r.lang) for r in landed.typed.collect()] == [(5, 9, None)]
    df.drop("text").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="text"):
        op.split_raw_reviews(spark, str(tmp_path / "q"), "parquet")


def test_the_detector_reads_unlabelled_rows_only(spark):
    df = spark.createDataFrame([("the cat is on the mat", "de"), ("the cat is on the mat", None), (None, None)], "text string, lang string")
    assert sorted(map(str, (r.lang for r in ingest.with_language(df).collect()))) == ["None", "de", "en"]
