"""Declared column types, checked once where data enters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("review_date", T.DateType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("brand", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
OPTIONAL_REVIEW_COLUMNS = ("review_date", "image_url", "price", "brand", "user_id", "parent_asin", "embedding")

RAW_REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)

# What raw reviews may come without: ids and labels are made later.
OPTIONAL_RAW_COLUMNS = ("review_id", "lang")

PRODUCTS = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("product_title", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("brand", T.StringType()),
        T.StructField("image_url", T.StringType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

PLAN = T.StructType(
    [
        T.StructField("search_queries", T.ArrayType(T.StringType())),
        T.StructField("sentiment", T.StringType()),
        T.StructField("product_hint", T.StringType()),
    ]
)

SOURCE = T.StructType(
    [
        T.StructField("product_title", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("session_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("q", T.StringType()),
        T.StructField("a", T.StringType()),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Fail if a table with rows has a required column without any value.

    Text formats give null for an absent field. Each check stops at the first value.
    """
    if not df.isEmpty():
        for name in columns:
            if df.filter(df[name].isNotNull()).isEmpty():
                raise ValueError(f"no value in column {name}")
    return df


def conform(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` with its types; missing optional columns become null.

    A missing required column fails here rather than deep inside a job.
    """
    missing = [f.name for f in schema if f.name not in df.columns and f.name not in optional]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.to(schema)
