"""Languages by the beginnings and ends of words, with weights learned from labelled texts.

The first and the last three letters of a word each give a code of fixed range; a language's weight of a code is the logarithm of
its share among that language's words, as a whole number, so that sums do not depend on their order. Texts are scored in
the row: codes are looked up by position in one array per language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.functions.language import WORD_BREAK
from opinarium.sources.writers import write_parquet

#: A letter counts by its code point modulo this; three of them and the side of the word make a code.
LETTERS = 32
CODES = 2 * LETTERS**3
#: Weights are logarithms times this, rounded.
SCALE = 1000


@dataclass(frozen=True)
class LanguageModel:
    """A whole number per language and code; ``languages`` are in order of precedence on equal scores."""

    languages: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]


def _code(letters: Column, side: int) -> Column:
    places = [F.pmod(F.ascii(F.substring(letters, i, 1)), F.lit(LETTERS)) for i in (1, 2, 3)]
    return ((F.lit(side) * LETTERS + places[0]) * LETTERS + places[1]) * LETTERS + places[2]


def edge_codes(text: Column) -> Column:
    """Two codes for every word of a text; short words count as filled with nothing."""
    words = F.filter(F.split(F.lower(text), WORD_BREAK), lambda word: word != "")
    ends = F.transform(words, lambda word: F.array(_code(word, 0), _code(F.right(word, F.lit(3)), 1)))
    return F.flatten(ends)


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Weights from all rows with a language; only counts per language and code, of which there is a fixed number, are collected."""
    codes = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(edge_codes(F.col(text))).alias("code"))
    counts = codes.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.log((F.col("n") + 1) / (F.col("total") + CODES)) * SCALE
    rows = counts.join(total, "lang").select("lang", "code", F.round(share).cast("int").alias("weight")).collect()
    # What a language does not have weighs as if counted zero times.
    rest = {r["lang"]: r["w"] for r in total.select("lang", F.round(F.log(1 / (F.col("total") + CODES)) * SCALE).cast("int").alias("w")).collect()}
    tables = {name: [rest[name]] * CODES for name in sorted(rest)}
    for r in rows:
        tables[r["lang"]][r["code"]] = r["weight"]
    return LanguageModel(tuple(tables), tuple(map(tuple, tables.values())))


def detect_by_edges(df: DataFrame, model: LanguageModel, text: str = "text", output: str = "detected") -> DataFrame:
    """Add ``output``: the language whose weights sum up highest over a whole text; null without a word or a language."""
    scores = [
        F.struct(
            F.aggregate("_codes", F.lit(0).cast("bigint"), lambda total, code: total + F.get(_literal(own), code)).alias("score"),
            F.lit(-place).alias("precedence"),
            F.lit(name).alias("language"),
        )
        for place, (name, own) in enumerate(zip(model.languages, model.weights))
    ]
    if not scores:
        return df.withColumn(output, F.lit(None).cast("string"))
    best = df.withColumn("_codes", edge_codes(F.col(text))).withColumn("_best", F.array_max(F.array(*scores)))
    return best.withColumn(output, F.when(F.size("_codes") > 0, F.col("_best.language"))).drop("_codes", "_best")


def _literal(values: tuple[int, ...]) -> Column:
    """An array literal, split from text, which the optimizer folds to one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def store_languages(spark: SparkSession, model: LanguageModel, path: str) -> DataFrame:
    """Write a model as ``place, lang, weights``."""
    rows = [(i, name, list(own)) for i, (name, own) in enumerate(zip(model.languages, model.weights))]
    return write_parquet(spark.createDataFrame(rows, "place int, lang string, weights array<int>"), path)


def load_languages(spark: SparkSession, path: str) -> LanguageModel:
    rows = spark.read.parquet(path).orderBy("place").collect()  # one row per language
    return LanguageModel(tuple(r["lang"] for r in rows), tuple(tuple(r["weights"]) for r in rows))
