"""Reading landed files. Nothing is loaded eagerly: pruning and pushdown reach the scan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinarium import schema
from opinarium.functions.text import is_blank
from opinarium.sources.writers import write_parquet

_BAD = "_bad"
MALFORMED, NO_OBJECT = "malformed JSON", "no JSON object"
#: Kinds of JSON values that can stand for a type; text takes any number or truth value as it is written.
_KINDS = {
    "bigint": ("BIGINT",),
    "double": ("BIGINT", "DECIMAL", "DOUBLE"),
    "string": ("STRING", "BIGINT", "DECIMAL", "DOUBLE", "BOOLEAN"),
}


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned reviews from Parquet."""
    return schema.conform(spark.read.parquet(path), schema.REVIEWS, schema.OPTIONAL_REVIEW_COLUMNS)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Stored review vectors, one float array per review."""
    return schema.conform(spark.read.parquet(path), schema.VECTORS)


class Landed(NamedTuple):
    """Raw reviews that could be read, and for the others ``record``, what stood there, and ``reasons``."""

    typed: DataFrame
    rejected: DataFrame


def _landed_schema() -> T.StructType:
    """Ratings are read as fractions, so that those that are not whole are seen."""
    return T.StructType([T.StructField(f.name, T.DoubleType()) if f.name == "rating" else f for f in schema.RAW_REVIEWS])


def _not_whole(rating: Column) -> Column:
    return F.coalesce(rating != F.floor(rating), F.lit(False))


def _wrong_kind(record: Column, field: T.StructField) -> Column:
    """A reason if a JSON member cannot stand for its field, else null."""
    kind = F.schema_of_variant(F.try_variant_get(record, f"$.{field.name}", "variant"))
    fits = F.regexp_like(kind, F.lit("^(VOID|" + "|".join(_KINDS[field.dataType.simpleString()]) + ")"))
    return F.when(~F.coalesce(fits, F.lit(True)), F.concat(F.lit(f"{field.name}: "), F.lower(F.regexp_extract(kind, "^[A-Z]+", 0))))


def split_raw_reviews(spark: SparkSession, path: str, format: str = "json") -> Landed:
    """Landed raw reviews, apart from rows that do not fit the declared schema: every row is in one of the two tables.

    JSON lines are read in one pass; only lines that Spark's reader could not fit are looked at again for the reasons: no
    JSON at all, no object, or members of another kind. In other formats a value that is lost by its cast is a
    reason. In all formats a rating that is not whole is one. Blank lines are no rows. Nothing is read before an action.
    """
    whole = F.when(_not_whole(F.col("rating")), F.lit("rating: not whole"))
    fields = _landed_schema()
    if format == "json":
        lines = spark.read.text(path).filter(~is_blank(F.col("value")))
        checked = T.StructType([*fields, T.StructField(_BAD, T.StringType())])
        row = F.from_json("value", checked, {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})
        read = lines.select(F.col("value").alias("_record"), row.alias("_row")).select("_record", "_row.*")
        record = F.when(F.col(_BAD).isNotNull(), F.try_parse_json("_record"))
        is_object = F.startswith(F.schema_of_variant(record), F.lit("OBJECT"))
        kinds = F.array(*[_wrong_kind(record, f) for f in fields])
        why = F.when(F.col(_BAD).isNull(), F.array().cast("array<string>")).otherwise(
            F.when(record.isNull(), F.array(F.lit(MALFORMED))).when(~is_object, F.array(F.lit(NO_OBJECT))).otherwise(kinds)
        )
        # What the reader refused has a reason, even one that none of the above names.
        unnamed = F.when(F.col(_BAD).isNotNull() & (F.size(F.array_compact(why)) == 0), F.lit(MALFORMED))
        # The reader takes the first element of an array of objects, and the values before a broken end.
        listed = F.when(F.col(_BAD).isNull() & F.startswith(F.ltrim("_record"), F.lit("[")), F.lit(NO_OBJECT))
        readable = F.col(_BAD).isNull() | F.coalesce(is_object, F.lit(False))
        reasons = F.array_compact(F.concat(why, F.array(unnamed, listed, F.when(readable, whole))))
    else:
        found = spark.read.format(format).load(path)
        given = [f for f in fields if f.name in found.columns]
        missing = [f.name for f in fields if f.name not in found.columns and f.name not in schema.OPTIONAL_RAW_COLUMNS]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        read = found.select(
            F.to_json(F.struct(*found.columns)).alias("_record"),
            *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in given],
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f not in given],
            F.array(*[F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
                             F.lit(f"{f.name}: {found.schema[f.name].dataType.simpleString()}")) for f in given]).alias("_lost"),
        )
        reasons = F.array_compact(F.concat("_lost", F.array(whole)))
    marked = read.withColumn("_reasons", reasons)
    typed = marked.filter(F.size("_reasons") == 0).select(*schema.RAW_REVIEWS.names)
    rejected = marked.filter(F.size("_reasons") > 0).select(F.col("_record").alias("record"), F.col("_reasons").alias("reasons"))
    return Landed(schema.conform(typed.withColumn("rating", F.col("rating").cast("int")), schema.RAW_REVIEWS), rejected)


def read_raw_reviews(spark: SparkSession, path: str, format: str = "json", rejects: str | None = None) -> DataFrame:
    """Raw reviews already landed as JSON lines or Parquet, with a declared schema.

    Ids and language labels may be absent and are then null. A rating may be written as ``5`` or ``5.0``. With ``rejects``, rows that
    do not fit are written there with their reasons (see ``split_raw_reviews``) and left out. Without, values that do not fit
    become null. A required field without any value is an error.
    """
    if rejects is not None:
        landed = split_raw_reviews(spark, path, format)
        write_parquet(landed.rejected, rejects)
        raw = landed.typed
    else:
        raw = spark.read.schema(_landed_schema()).json(path) if format == "json" else spark.read.format(format).load(path)
        if "rating" in raw.columns:
            raw = raw.withColumn("rating", F.when(~_not_whole(F.col("rating")), F.col("rating").cast("int")))
        raw = schema.conform(raw, schema.RAW_REVIEWS, schema.OPTIONAL_RAW_COLUMNS)
    return schema.require(raw, tuple(n for n in raw.columns if n not in schema.OPTIONAL_RAW_COLUMNS))


def read_products(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Product metadata landed as JSON lines or Parquet."""
    if format == "json":
        products = spark.read.schema(schema.PRODUCTS).json(path)
        return schema.require(products, ("parent_asin", "product_title"))
    return schema.conform(spark.read.format(format).load(path), schema.PRODUCTS)
