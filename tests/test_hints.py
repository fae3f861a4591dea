import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opinarium.operators.filters import title_matches
from opinarium.operators.hints import well_formed

TITLES = ["src1", "xSRC10", "Kettle 1.7 l (steel)", "usb-c cable", "C++ primer", "a", "", "ab ab", "é Ünder", "漢字 tv", "a]b}c", "x\ny", "[a-z]+", "tv & radio", "aaa", "1-2"]
#: Expressions that both dialects read, and what is looked for as it stands.
SOUND = [
    "s.c1", "^src", "1$", "src1|kettle", "(src|(ket)?tle) ?1", "(?:a(?:b)) (?=ab)", "a(?!b)", "[a-c]{2}", "[^a-z ]", r"\d\.\d", r"\bl\b", r"\p{L}+ \p{N}",
    "usb[- ]c", "[-a]b", "[a-]b", r"[\d.]+", r"[\]\-]b", "a*?b", "a++", "a{2,3}", "a{2}", "x.y", "(a|)", "()", "a||b", r"\(steel\)", "tv [&] radio", "}c", "]b", r"\+\+", "(((a)))", "É ü", r"\w+ü", "^$", "((a)|b)* ab", r"c\\", "|", "c++",
]
PLAIN = [
    "src1++(", "(", ")", "a)", "[", "[]", "[]a]", "[z-a]", "[a-b-c]", "a{3,2}", "a{", "{2}", "a**", "*a", "(?P<x>a)", "(?i)a", "(?<=a)b", r"\1", r"\q", "\\", r"\\p{L}", r"\p{Q}", "a{,2}", "[[a]", "[a&&b]", "^*", r"\b+", "(*)", "a{1000}", "[^]", "\ue000.", r"(a)\1", "(?", "|*",
]


def verdicts(spark, hints):
    df = spark.createDataFrame(list(enumerate(hints)), "n int, h string").repartition(3)
    return [r.ok for r in df.withColumn("ok", well_formed(F.col("h"))).orderBy("n").collect()]


def found(spark, hints, titles):
    pairs = [(i, j, t, h) for i, h in enumerate(hints) for j, t in enumerate(titles)]
    df = spark.createDataFrame(pairs, "i int, j int, t string, h string").repartition(3)
    rows = df.withColumn("m", title_matches(F.col("t"), F.col("h"))).collect()
    return {(hints[r.i], titles[r.j]) for r in rows if r.m}


def python_says(hint, title):
    return re.search(re.sub(r"\\p\{L\}", r"[^\\W\\d_]", hint).replace(r"\p{N}", r"\d"), title, re.IGNORECASE) is not None


def test_expressions_match_as_python_reads_them(spark):
    assert verdicts(spark, SOUND) == [True] * len(SOUND)
    assert found(spark, SOUND, TITLES) == {(h, t) for h in SOUND for t in TITLES if python_says(h, t)}


def test_others_are_plain_text(spark):
    assert verdicts(spark, PLAIN) == [False] * len(PLAIN)
    assert found(spark, PLAIN, [*TITLES, *PLAIN]) == {(h, t) for h in PLAIN for t in [*TITLES, *PLAIN] if h.lower() in t.lower()}


def test_random_hints_never_stop_a_job(spark):
    rng = random.Random(5)
    signs = list(r"ab1 \\()[]{}|*+?^$.-,&:=!dwpLN0") + ["(?:", "[a", "{1", r"\p{L}", "é"]
    hints = sorted({"".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(1500)})
    titles = ["ab1 a.b", "a(b)[1]", "b" * 20]
    got, sound = found(spark, hints, titles), dict(zip(hints, verdicts(spark, hints)))
    assert sum(sound.values()) > 100
    for hint in hints:
        if "\\p" in hint and sound[hint]:
            continue  # categories are not Python's
        for title in titles:
            want = python_says(hint, title) if sound[hint] else hint.lower() in title.lower()
            assert ((hint, title) in got) == want, (hint, title)


def test_missing_values(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("a", "")], "t string, h string")
    assert [r.m for r in df.select(title_matches(F.col("t"), F.col("h")).alias("m")).collect()] == [False, False, False, True]


LONG = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from opinarium import build_session
from opinarium.operators.filters import title_matches
spark = build_session("cold", master="local[2]", **{{"spark.ui.enabled": "false"}})
hints = ["a" * 1_000_000, "a." * 500_000, "(" * 100_000, "(a|b)*" * 80, "[" * 5000, "\\\\" * 99_999, "(a|b)*c", "(" * 40 + "a" + ")" * 40, "a{{999}}" * 70]
titles = ["a" * 1_000_001, "ab" * 500, "b", "ab" * 100_000]
df = spark.createDataFrame([(t, h) for t in titles for h in hints], "t string, h string")
print("matches", df.filter(title_matches(F.col("t"), F.col("h"))).count())
"""


def test_long_hints_in_a_cold_jvm():
    code = LONG.format(root=str(Path(__file__).resolve().parent.parent))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "matches" in run.stdout and "StackOverflow" not in run.stderr, run.stderr[-2000:]
