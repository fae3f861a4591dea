"""Exact copies by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Lengths and beginnings go to a narrow table without texts. A length, then a beginning, that occurs once has no copy. Those that
occur more often are marked in a bit table of a fixed size, against which rows are tested where they lie, so
only rows of surviving groups have their whole content hashed, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm.tables import written

#: Characters of a beginning.
PREFIX = 256
#: Words of 64 bits in a bit table, which is all of it that is ever broadcast: 16 MB.
WORD_BITS = 20
#: A group with more than one in so many of the copies is joined by broadcast: there cannot be more groups like it.
HOT_SHARE = 1024


def normalised(text: Column) -> Column:
    """The text with each run of ASCII blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _word(key: Column) -> Column:
    return key.bitwiseAND((1 << WORD_BITS) - 1)


def _bit(key: Column) -> Column:
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(key, WORD_BITS).bitwiseAND(63).cast("int")
    )


def _marks(keys: DataFrame) -> DataFrame:
    """``_word, _bits``: the hashes ``_key`` as set bits, in at most ``2 ** WORD_BITS`` rows."""
    return keys.groupBy(_word(F.col("_key")).alias("_word")).agg(F.bit_or(_bit(F.col("_key"))).alias("_bits"))


def _tested(rows: DataFrame, key: Column, marks: DataFrame) -> DataFrame:
    """``rows`` with ``_marked``: whether the bit of ``key`` is set. Keys that share a bit cost work, never a result."""
    found = rows.join(F.broadcast(marks), _word(key) == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(_bit(key)) != 0, F.lit(False))
    return found.withColumn("_marked", hit).drop("_word", "_bits")


def _refined(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Marks of the keys that occur more than once."""
    repeated = rows.groupBy(key.alias("_key")).count().filter("count > 1")
    return written(_marks(repeated), name)


def _hashed(docs: DataFrame, carried: Column) -> DataFrame:
    """``_row, _id, _full, _nth``: the hash of the whole text, where length and beginning leave a copy possible."""
    text = normalised(F.col("text"))
    length, start = F.octet_length(text).alias("_length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("_start")
    ledger = written(docs.select(length, start), "exact-ledger")
    by_length = F.xxhash64("_length")
    by_start = F.xxhash64("_length", "_start")
    lengths = _refined(ledger, by_length, "exact-lengths")
    starts = _refined(_tested(ledger, by_length, lengths).filter("_marked"), by_start, "exact-starts")
    whole = docs.select(carried.alias("_row"), F.col("doc_id").alias("_id"), text.alias("_text")).withColumns(
        {"_length": F.octet_length("_text"), "_start": F.xxhash64(F.substring("_text", 1, PREFIX))}
    )
    tested = _tested(whole, by_start, starts)
    return written(
        tested.select(
            "_row", "_id", F.when(F.col("_marked"), F.sha2("_text", 256)).alias("_full"),
            F.monotonically_increasing_id().alias("_nth"),
        ),
        "exact-hashed",
    )


def exact_copies(docs: DataFrame, carried: Column) -> DataFrame:
    """``_row, keep_id, group_size, kept`` of every row; ``_row`` is a struct carried along.

    Texts are equal if they are after ``normalised``; null, empty and blank-only texts follow that rule (null and empty are
    equal, blanks alone are one space). Of equal texts the row with the smallest doc_id stays, once if that id is
    repeated; a row without an id stays only if none of its group has one, and ``keep_id`` is then null. No rows in, none out.

    The group with a third of all rows is joined by broadcast like every group of its kind; the others by their hash.
    """
    rows = _hashed(docs, carried)
    first = F.coalesce(F.min_by("_nth", "_id"), F.min("_nth"))
    groups = written(
        rows.filter("_full IS NOT NULL")
        .groupBy(F.col("_full").alias("_group"))
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"), first.alias("_first"))
        .filter("_size > 1"),
        "exact-groups",
    )
    copies = groups.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    hot = F.broadcast(groups.filter(F.col("_size") * HOT_SHARE > copies))
    rest = groups.filter(F.col("_size") * HOT_SHARE <= copies)
    same = F.col("_full") == F.col("_group")
    hashed = rows.filter("_full IS NOT NULL")
    joined = (
        hashed.join(hot, same)
        .unionByName(hashed.join(hot, same, "left_anti").join(rest, same, "left"), allowMissingColumns=True)
        .unionByName(rows.filter("_full IS NULL"), allowMissingColumns=True)
    )
    return joined.select(
        "_row",
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("_nth") == F.col("_first"), F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One whole row of every set of equal texts, the one that ``exact_copies`` keeps."""
    return exact_copies(docs, F.struct("*")).filter("kept").select("_row.*")


def copy_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, the digest being that of its normalised text."""
    digest = F.sha2(normalised(F.col("text")), 256).alias("text_sha256")
    found = exact_copies(docs, F.struct("doc_id", digest))
    return found.select("_row.doc_id", "keep_id", "group_size", "kept", "_row.text_sha256")
