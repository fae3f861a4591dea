"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document; its bit and its measurements are stored. A policy is a versioned set of
rules, applied to the ledger by a mask, and what a policy would keep without one of its rules follows from counts
per bit pattern. Everything is SQL functions in one pass over the texts, without an exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinarium.llm.tables import BLANKS

WINDOW = 5

#: Rules in the order of their bits: name and condition of failure over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 2 AND 2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("many_words", "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(name) for name in self.rules)


def bit(name: str) -> int:
    return 1 << [rule for rule, _ in RULES].index(name)


BASE = ("few_words", "repeated_windows")
POLICIES = {
    policy.version: policy
    for policy in (
        Policy("base", BASE),
        Policy("2024-1", (*BASE, "symbols")),
        Policy("2024-2", (*BASE, "symbols", "repeated_lines", "word_length")),
    )
}
CURRENT = "2024-2"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within windows of WINDOW words that are found at least twice."""

    def windows(hashes: Column) -> Column:
        parts = lambda i: [F.get(hashes, i + k) for k in range(WINDOW)]
        places = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.when(F.size(hashes) >= WINDOW, F.transform(places, lambda i: F.xxhash64(*parts(i))))

    def covered(sorted_: Column) -> Column:
        key = lambda k: F.get(sorted_, k)["key"]
        n = F.size(sorted_)
        twice = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: ((k > 0) & (key(k) == F.when(k > 0, key(k - 1)))) | ((k < n - 1) & (key(k) == key(k + 1))),
        )
        places = F.array_sort(F.transform(twice, lambda k: F.get(sorted_, k)["place"]))
        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
        return F.reduce(
            places,
            start,
            lambda acc, place: F.struct(
                (acc["total"] + F.least(F.lit(WINDOW), place - acc["last"])).alias("total"), place.alias("last")
            ),
            lambda acc: acc["total"],
        )

    def repeated(found: Column) -> Column:
        keyed = F.transform(found, lambda key, place: F.struct(key.alias("key"), place.alias("place")))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(
            _bound(F.sort_array(keyed), covered)
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(_bound(_bound(hashes, windows), repeated), F.lit(0)).cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed``, the bits of the rules that the text breaks.

    Words lie between ASCII blanks; null text has none. Windows are compared by two rounds of 64-bit hashes. Rows are independent:
    repeated ids, null ids and any other columns do no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    split = docs.select("doc_id", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    measured = split.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(broken), F.lit(bit(name))).otherwise(0) for name, broken in RULES]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("bigint"))


def verdict(policy: Policy) -> Column:
    """Whether a ledger row passes all rules of a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """``rule, failing, alone``: documents that break a rule of the policy, and those that break no other of it.

    ``alone`` is what the policy would keep more of without the rule. Counted over bit patterns, of which there are
    at most two to the power of the rules, each summed up before it is moved.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("pattern")).count()
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).alias("bit")) for n in policy.rules])
    each = patterns.select("pattern", "count", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("pattern").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("pattern") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("alone"),
    )
