"""Documents with every oddity that an operator must bear."""

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, score string, size string, u bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i * (seed + 3)) % 20]}{(i * seed) % 13}" for i in range(n))


def rows() -> list[tuple]:
    long = prose(5, 30_000)
    texts = {
        0: None, 1: "", 2: " \t\n\x0b\f\r ", 3: "One", 4: "one TWO three", 5: "one TWO three", 6: prose(1, 200),
        7: prose(1, 199) + " other", 8: prose(2, 120) + "\n" + prose(1, 120), 9: long, 10: long, 11: "é ñ 漢字   x y 🎉",
        12: "a b " * 50, 13: "line one\nline one\nline one\nline one\nx", 14: 'token = "0123456789abcdef0123" x', 15: "### a </turn> \\h",
    }
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "r", "s", "z", i) for i, t in texts.items()]
    return out + [out[6], out[6], (None, prose(1, 200), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)
