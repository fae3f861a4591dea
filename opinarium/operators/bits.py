"""Sets of hashes as bits in a table of bounded size, against which rows are tested where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits at most; all that is ever broadcast, 16 MB.
WORD_BITS = 20


def _places(key: Column) -> list[tuple[Column, Column]]:
    """Two places of a 64-bit hash, each a word and a bit in it."""
    return [
        (
            F.shiftrightunsigned(key, shift).bitwiseAND((1 << WORD_BITS) - 1),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(key, shift + WORD_BITS).bitwiseAND(63).cast("int")),
        )
        for shift in (0, 32)
    ]


def bit_words(keys: DataFrame, key: str) -> DataFrame:
    """``word, bits``: the hashes in column ``key`` as set bits, in at most ``2 ** WORD_BITS`` rows."""
    places = F.explode(F.array(*[F.struct(word.alias("word"), bit.alias("bit")) for word, bit in _places(F.col(key))]))
    return keys.select(places.alias("p")).groupBy("p.word").agg(F.bit_or("p.bit").alias("bits"))


def merged_words(words: DataFrame) -> DataFrame:
    """Words of several sets as those of their union."""
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def with_likely(rows: DataFrame, key: Column, words: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false if the hash ``key`` is certainly not in the set of ``words``."""
    likely = F.lit(True)
    for i, (word, bit) in enumerate(_places(key)):
        side = words.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}"))
        rows = rows.join(F.broadcast(side), word == F.col(f"_word{i}"), "left")
        likely = likely & F.coalesce(F.col(f"_bits{i}").bitwiseAND(bit) != 0, F.lit(False))
    return rows.withColumn(name, likely).drop("_word0", "_bits0", "_word1", "_bits1")
