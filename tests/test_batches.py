import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import opinarium as op
from opinarium.operators import bits
from opinarium.plans import batches

REVIEWS = "review_id bigint, product_title string, rating int, sentiment string, review_date date, image_url string, price double"


def reviews(spark, n=600, seed=1):
    rng = random.Random(seed)
    start = datetime.date(2019, 11, 20)
    rows = [
        (i, rng.choice(["hot"] * 6 + ["a", "b", "c", None]), rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["pos", "neu", "neg", None]),
         rng.choice([None, start + datetime.timedelta(days=rng.randrange(120))]), rng.choice([None, f"img{i}"]), rng.choice([None, -1.0, 0.0, 30.0, 99.0, 500.0]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, REVIEWS).repartition(4)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=str)


def test_batches_equal_a_full_rebuild(spark, tmp_path):
    df, path = reviews(spark), str(tmp_path / "s")
    for i in (2, 0, 1):  # days come back late in every batch
        batches.add_batch(df.filter(F.col("review_id") % 3 == i), path, f"b{i}")
    assert rows(batches.refresh_daily(spark, path)) == rows(op.daily_sentiment(df))
    assert rows(batches.merged_brackets(spark, path)) == rows(op.price_brackets(df))
    assert rows(batches.merged_leaderboard(spark, path, df)) == rows(op.leaderboard(df))
    batches.add_batch(df.filter("review_id % 3 = 1"), path, "b1")  # the same batch again counts once
    assert rows(batches.merged_brackets(spark, path)) == rows(op.price_brackets(df))
    batches.merge_batches(spark, path, str(tmp_path / "m"), "all")
    assert rows(batches.merged_leaderboard(spark, str(tmp_path / "m"), df, 2)) == rows(op.leaderboard(df, 2))
    assert rows(batches.refresh_daily(spark, str(tmp_path / "m"))) == rows(op.daily_sentiment(df))


def test_a_late_day_rewrites_its_month_only(spark, tmp_path):
    df, path = reviews(spark), str(tmp_path / "s")
    late = F.col("review_date") == datetime.date(2020, 1, 7)
    batches.add_batch(df.filter(~F.coalesce(late, F.lit(False))), path, "b0")
    batches.refresh_daily(spark, path)
    before = {f: f.stat().st_mtime_ns for f in Path(path, "daily").rglob("*.parquet")}
    batches.add_batch(df.filter(late), path, "b1")
    months = batches.touched_months(spark, path, ["b1"])
    assert months == ["2020-01"]
    assert rows(batches.refresh_daily(spark, path, months)) == rows(op.daily_sentiment(df))
    after = {f: f.stat().st_mtime_ns for f in Path(path, "daily").rglob("*.parquet")}
    assert {f.parent.name for f in set(before.items()) ^ set(after.items()) for f in [f[0]]} == {"month=2020-01"}


def test_no_reviews(spark, tmp_path):
    df, path = reviews(spark, 0), str(tmp_path / "s")
    assert batches.merged_brackets(spark, path).count() == 0
    batches.add_batch(df, path, "b0")
    assert batches.touched_months(spark, path, ["b0"]) == [] and batches.merged_leaderboard(spark, path, df).count() == 0


def raw(spark, n, seed=3):
    rng = random.Random(seed)
    made = [(i, rng.choice("uvw"), rng.choice(["p", None]), rng.choice(["hot", "1:a", "a", "", None, str(i % 40)])) for i in range(n)]
    return spark.createDataFrame(made, "review_id bigint, user_id string, parent_asin string, text string").repartition(3)


@pytest.mark.parametrize("word_bits", [20, 0])
def test_two_batches_equal_one(spark, tmp_path, monkeypatch, word_bits):
    """With one word for all bits nearly every row is a likely repeat, and results stay the same."""
    monkeypatch.setattr(bits, "WORD_BITS", word_bits)
    df, store = raw(spark, 300), str(tmp_path / "s")
    parts = [df.filter("review_id < 120"), df.filter("review_id BETWEEN 120 AND 200"), df.filter("review_id > 200")]
    kept = [rows(batches.dedupe_batch(part, store, f"b{i}")) for i, part in enumerate(parts)]
    assert sorted(sum(kept, []), key=str) == rows(op.dedupe(df))
    assert rows(batches.dedupe_batch(parts[1], store, "b1")) == kept[1]  # run again


def test_rows_without_an_id_stay(spark, tmp_path):
    df = raw(spark, 20).withColumn("review_id", F.lit(None).cast("bigint"))
    assert batches.dedupe_batch(df, str(tmp_path / "s"), "a").count() == 20
    assert batches.dedupe_batch(df, str(tmp_path / "s"), "b").count() == 20


def test_new_rows_do_not_meet_the_store(spark):
    rows_ = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    words = bits.bit_words(rows_.limit(5000), "h")
    likely = bits.with_likely(spark.range(50_000, 60_000).select(F.xxhash64("id").alias("h")), F.col("h"), words, "likely")
    assert likely.filter("likely").count() < 20
    assert bits.with_likely(rows_.limit(5000), F.col("h"), words, "likely").filter("NOT likely").count() == 0


def test_sketches_of_days_merge(spark):
    df = reviews(spark, 900).withColumn("product_title", F.concat(F.lit("t"), (F.col("review_id") % 250).cast("string")))
    daily = op.daily_titles(df).cache()
    exact = df.filter("review_date BETWEEN '2019-12-01' AND '2020-01-31'").select("product_title").distinct().count()
    assert abs(op.titles_between(daily, "2019-12-01", "2020-01-31").first().sketched - exact) <= 0.03 * exact
    assert op.titles_between(daily, "2031-01-01").first().sketched == 0
    counted = op.distinct_titles(df).first()
    assert counted.unique_products == 250 and abs(counted.sketched - 250) <= 8
