import datetime
import json

import pytest
from pyspark.sql import functions as F

import opinarium as op
from catalog.views import load
from opinarium import schema
from opinarium.plans import ingest

SF = "/root/testdata/sf0.001"
RAW = "review_id bigint, user_id string, parent_asin string, text string, lang string, rating int, ts_ms bigint"


def raw(spark):
    long = "long enough to be kept"
    rows = [
        (1, "u", "p", long, "en", 5, 0), (2, "u", "p", long, "en", 1, 0), (3, "v", "p", long, "en", 3, 1262304000000),
        (4, "u", "q", long, "en", 2, 0), (5, "u", "p", "  short \n" + " " * 30, "en", 5, 0), (6, "w", "p", long, "de", 5, 0),
        (7, "x", "p", long + "!", "en", None, 0),
    ]
    return spark.createDataFrame(rows, RAW)


def products(spark):
    return spark.createDataFrame([("p", "Title", 9.5, "B", "img"), ("z", "Other", 1.0, "B", None)],
                                 "parent_asin string, product_title string, price double, brand string, image_url string")


def test_whole_chain(spark):
    got = {r.review_id: r for r in op.clean_reviews(raw(spark), products(spark)).collect()}
    assert set(got) == {1, 3, 7}
    assert (got[1].sentiment, got[3].sentiment, got[7].sentiment) == ("pos", "neu", None)
    assert got[3].review_date == datetime.date(2010, 1, 1) and got[1].product_title == "Title"


def test_limit_comes_first(spark):
    assert {r.review_id for r in op.clean_reviews(raw(spark), products(spark), n=2).collect()} == {1}


def test_needed_products_and_join_kinds(spark):
    assert [r.parent_asin for r in op.needed_products(products(spark), raw(spark)).collect()] == ["p"]
    assert op.with_metadata(raw(spark), products(spark)).count() == 6
    assert op.with_metadata(raw(spark), products(spark), how="left").filter("product_title is null").count() == 1


def test_one_set_of_copies_holds_most_rows(spark):
    df = spark.range(3000).select(
        F.col("id").alias("review_id"), F.lit("u").alias("user_id"), F.lit("p").alias("parent_asin"),
        F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(9)
    got = op.dedupe(df)
    assert got.count() == 1001
    assert got.filter("text = 'same'").first().review_id == 1


def test_readers(spark, tmp_path):
    rows = [r.asDict() for r in raw(spark).collect()]
    (tmp_path / "raw.json").write_text("\n".join(json.dumps(r) for r in rows))
    read = op.read_raw_reviews(spark, str(tmp_path / "raw.json"))
    assert sorted(read.collect()) == sorted(raw(spark).collect())
    stored = op.write_parquet(raw(spark), str(tmp_path / "raw"))
    assert op.read_raw_reviews(spark, str(tmp_path / "raw"), "parquet").count() == stored.count() == 7
    op.write_parquet(products(spark), str(tmp_path / "p"))
    assert op.read_products(spark, str(tmp_path / "p"), "parquet").count() == 2
    cleaned = op.clean_reviews(raw(spark), products(spark))
    op.write_parquet(cleaned, str(tmp_path / "c"))
    assert op.read_reviews(spark, str(tmp_path / "c")).schema.names == schema.REVIEWS.names
    with pytest.raises(ValueError, match="product_title"):
        op.read_reviews(spark, str(tmp_path / "raw"))


def test_marts_are_read_back(spark, tmp_path):
    built = op.build_marts(load(spark, SF, "rv"), str(tmp_path / "m"), sample=100)
    stored = op.read_marts(spark, str(tmp_path / "m"))
    assert {k: v.count() for k, v in stored.items()} == {k: v.count() for k, v in built.items()}
    assert stored["sample"].count() == 100
    assert op.sentiment_trend(stored["daily"]).count() == stored["daily"].count()


def test_scan_is_pruned(spark):
    plan = ingest.english_only(load(spark, SF, "raw_reviews")).select("review_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_instants_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(1262304000123,), (-1,), (None,)], "ts_ms bigint")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = [(r.review_ts, r.review_date) for r in ingest.with_instant(df).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [
        (datetime.datetime(2010, 1, 1, 0, 0, 0, 123000), datetime.date(2010, 1, 1)),
        (datetime.datetime(1969, 12, 31, 23, 59, 59, 999000), datetime.date(1969, 12, 31)),
        (None, None),
    ]


def test_raw_json_as_it_is_found(spark, tmp_path):
    rows = [r.asDict() for r in raw(spark).collect()]
    for r in rows:
        del r["review_id"], r["lang"]
        r["rating"] = None if r["rating"] is None else float(r["rating"])
        r["text"] = "this is the text that is " + r["text"]
    lines = [json.dumps(r) for r in rows]
    (tmp_path / "raw.json").write_text("\n".join(lines + lines[:1]))  # one review twice
    read = op.read_raw_reviews(spark, str(tmp_path / "raw.json"))
    assert sorted(r.rating for r in read.collect() if r.rating) == [1, 2, 3, 5, 5, 5, 5]
    once = ingest.with_ids(read)
    assert once.count() == 7 and once.select("review_id").distinct().count() == 7
    again = ingest.with_ids(read.repartition(5))
    assert sorted(r.review_id for r in once.collect()) == sorted(r.review_id for r in again.collect())
    assert op.clean_reviews(read, products(spark)).count() == 5


def test_a_field_without_values_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps({"user": "u", "text": "t"}))
    with pytest.raises(ValueError, match="user_id"):
        op.read_raw_reviews(spark, str(tmp_path / "bad.json"))


def test_nothing_is_cut_off(spark):
    many = spark.range(120_000).selectExpr(
        "id review_id", "cast(id as string) user_id", "'p' parent_asin", "concat('a text that is long enough ', id) text",
        "'en' lang", "5 rating", "0L ts_ms")
    assert op.clean_reviews(many, products(spark)).count() == 120_000


def test_rows_without_ids_or_labels_stay(spark):
    df = raw(spark).withColumn("review_id", F.lit(None).cast("bigint"))
    assert op.dedupe(df).count() == 7
    assert op.clean_reviews(df, products(spark)).count() == 3
    unlabelled = raw(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.concat(F.lit("this is the "), "text"))
    assert op.clean_reviews(unlabelled, products(spark)).count() == 4


def test_stored_reviews_feed_the_marts(spark, tmp_path):
    cleaned = op.clean_reviews(raw(spark), products(spark))
    op.write_parquet(cleaned.withColumn("image_url", F.lit(None).cast("string")), str(tmp_path / "c"))
    built = op.build_marts(op.read_reviews(spark, str(tmp_path / "c")), str(tmp_path / "m"))
    assert built["brackets"].first().review_count == 3
