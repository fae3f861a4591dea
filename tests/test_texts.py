import pytest

import opinarium as op
from opinarium import fixed as V
from opinarium.plans.retrieval import clean_questions, variants

Q = "question_id bigint, question string, sentiment string, product_hint string"


def texts(spark, text):
    return spark.createDataFrame([(1, text)], "text_id bigint, txt string")


def sections(df):
    got = {}
    for r in df.orderBy("section", "item_no").collect():
        got.setdefault(r.section, []).append(r["item"])
    return got


def test_pros_cons(spark):
    text = "PROS: great\n1. Light - easy\n2 3.5mm jack\nx\n**CONS**\n3. Loud\nCONS\n1. Heat"
    assert sections(op.parse_pros_cons(texts(spark, text))) == {
        "pros": ["Light - easy", "5mm jack", "Loud"], "cons": ["Heat"]}


@pytest.mark.parametrize("text", ["", "no headers\n1. lost", "PROS", None])
def test_pros_cons_without_points(spark, text):
    assert op.parse_pros_cons(texts(spark, text)).count() == 0


def test_pros_cons_odd_lines(spark):
    text = "  pros\r\n1) no dot\x0b2. a.b.c 3.\nCons here\n٣. arabic digit\n². raised\npros\n4. again"
    assert sections(op.parse_pros_cons(texts(spark, text))) == {
        "pros": ["1) no dot", "a.b.c", "", "again"], "cons": ["arabic digit", "raised"]}


def test_compare(spark):
    text = ("**Where A Wins:** inline lost\n1. Lighter\n- **Battery** lasts\n**Where B Wins:**\n2x zoom\n"
            "**Verdict:** Buy A.\nIf you travel.")
    assert sections(op.parse_compare(texts(spark, text))) == {
        "a_wins": ["Lighter", "Battery** lasts"], "b_wins": ["x zoom"], "verdict": ["Buy A. If you travel."]}


def test_compare_repeated_and_reset(spark):
    text = ("lost\n# Where A wins\n***\n1) one\nwhere b wins\n- two\nVerdict\nfirst\nwhere A wins\n3. three\n"
            "**VERDICT** second\n- third")
    assert sections(op.parse_compare(texts(spark, text))) == {
        "a_wins": ["one", "three"], "b_wins": ["two"], "verdict": ["second third"]}


def plan(spark, raw):
    df = spark.createDataFrame([(1, "asked", raw)], "plan_id bigint, question string, raw string")
    row = op.parse_query_plans(df).first()
    return row.search_queries, row.sentiment, row.product_hint


FALLBACK = (["asked"], "any", None)


@pytest.mark.parametrize("raw, want", [
    ('{"search_queries":["a","b"],"sentiment":"neg","product_hint":"x"}', (["a", "b"], "neg", "x")),
    ('```json\n{"search_queries":["a"],"sentiment":"pos","product_hint":null}\n```', (["a"], "pos", None)),
    ('```\n{"search_queries":["a"]}\n``` and more', (["a"], "any", None)),
    ('  {"search_queries":[],"sentiment":"pos"} \n', (["asked"], "pos", None)),
    ("{}", FALLBACK), ("", FALLBACK), (None, FALLBACK), ("not json", FALLBACK),
    ('{"search_queries":["a"],"sentiment":"neg"', FALLBACK), ("['a']", FALLBACK), ("{'sentiment':'neg'}", FALLBACK),
    ('{"search_queries":["a"],"sentiment":"neg"} trailing', FALLBACK),
])
def test_query_plan(spark, raw, want):
    assert plan(spark, raw) == want


def test_at_most_three_variants(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "question_id bigint, search_queries array<string>")
    assert [(r.query_no, r["query"]) for r in variants(df).collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_questions(spark):
    df = spark.createDataFrame([("\na\t",), (" \n",), ("",), (None,)], "question string")
    assert [r.question for r in clean_questions(df).collect()] == ["a"]


def hits(spark, n):
    rows = [(1, i + 1, f"p{i}", 5 if i else None, "pos", "t" * 600) for i in range(n)]
    return spark.createDataFrame(rows, "question_id bigint, number int, product_title string, rating int, sentiment string, text string")


def test_answer_prompt_and_nothing_found(spark):
    questions = spark.createDataFrame([(1, "why", "any", None), (2, "else", "neg", None)], Q)
    got = {r.question_id: r for r in op.answer_prompts(hits(spark, 12), questions).collect()}
    blocks = got[1].prompt.split("Reviews:\n", 1)[1].split("\n\n")
    assert got[1].prompt.startswith("Question: why\n\nReviews:\n[Review 1] Product: p0 | Rating: nan/5 | Sentiment: pos\nttt")
    assert [b.split("]")[0] for b in blocks] == [f"[Review {i}" for i in range(1, 13)]
    assert blocks[1].split("\n")[1] == "t" * 500
    assert (got[2].n_hits, got[2].prompt, got[2].answer) == (0, None, V.NOTHING_FOUND)


def test_compare_prompt_guards(spark):
    rows = [(i, "a" if i < 20 else "b", 4, f"text {i}") for i in range(23)] + [(50, "c", 1, "x")]
    reviews = spark.createDataFrame(rows, "review_id bigint, product_title string, rating int, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", None), ("a", "c"), ("b", "z")], "product_a string, product_b string")
    got = {(r.product_a, r.product_b): r for r in op.compare_prompts(reviews, pairs).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "z")}
    lines = got["a", "b"].prompt.splitlines()
    assert [x for x in lines if x.startswith("- ")] == [f"- [4/5] text {i}" for i in [*range(15), 20, 21, 22]]
    assert got["a", "c"].answer == got["b", "z"].answer == V.NOT_ENOUGH_TO_COMPARE
    assert op.compare_sides(reviews, pairs).count() == 18


def test_prompts_and_parsers_use_no_python_functions(spark):
    for df in (op.parse_pros_cons(texts(spark, "x")), op.parse_compare(texts(spark, "x"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("hint,title,found", [
    ("src1", "SRC10", True), ("c++(", "my C++(x", True), ("c++(", "ccc", False), ("(usb|hdmi) hub", "HDMI hub", True), ("a[", "A[b", True),
    ("a.c", "abc", True), ("[z-a]", "x[z-a]", True), ("*", "a*b", True), ("\\\\E(", "x\\\\e(", True), ("a{2}", "caat", True), ("a{99999999999}", "a", False),
])
def test_any_hint_is_safe(spark, hint, title, found):
    from opinarium.operators.filters import title_matches

    df = spark.createDataFrame([(hint, title), ("ok", "ok")], "h string, t string")
    got = [r.m for r in df.select(title_matches(df.t, df.h).alias("m")).collect()]
    assert got == [found, True]


def test_plan_fields_fall_back_one_by_one(spark):
    raw = [(1, '{"search_queries":"abc","sentiment":"neg","product_hint":"tv"}'), (2, '{"search_queries":["a"],"sentiment":3,"product_hint":["x"]}'),
           (3, '["a"]'), (4, '{"search_queries":["a"],"sentiment":"pos"'), (5, '{"sentiment":"pos"}')]
    df = spark.createDataFrame([(i, "q", r) for i, r in raw], "plan_id int, question string, raw string")
    got = {r.plan_id: (r.search_queries, r.sentiment, r.product_hint) for r in op.parse_query_plans(df).collect()}
    assert got == {1: (["q"], "neg", "tv"), 2: (["a"], "any", None), 3: (["q"], "any", None), 4: (["q"], "any", None), 5: (["q"], "pos", None)}


@pytest.mark.parametrize("value, text", [("3", None), ("4.5", None), ("true", None), ("null", None), ('{"a":1}', None), ('["x"]', None), ('"x"', "x"), ('""', "")])
def test_plan_members_are_never_coerced(spark, value, text):
    raw = f'{{"search_queries":{value},"sentiment":{value},"product_hint":{value}}}'
    df = spark.createDataFrame([(1, "q", raw)], "plan_id int, question string, raw string")
    got = op.parse_query_plans(df).first()
    queries = ["x"] if value == '["x"]' else ["q"]
    assert (got.search_queries, got.sentiment, got.product_hint) == (queries, "any" if text is None else text, text)


def test_plans_that_are_no_objects(spark):
    raw = ["3", '"x"', "[1]", "null", "", None, "{} x", '{"sentiment":"pos"} {"sentiment":"neg"}', "{'sentiment':'neg'}", '{"sentiment":"neg"', "```json\n{\"sentiment\":\"neg\"}\n```", "[" * 3000]
    df = spark.createDataFrame([(i, "q", r) for i, r in enumerate(raw)], "plan_id int, question string, raw string")
    got = {r.plan_id: r.sentiment for r in op.parse_query_plans(df).collect()}
    assert got == {i: "neg" if i == 10 else "any" for i in range(len(raw))}


def test_queries_of_another_type_are_left_out(spark):
    raw = ['{"search_queries":["a",3,null,["b"],{"c":1},"d",true]}', '{"search_queries":[1,2]}', '{"search_queries":[]}', '{"search_queries":{"a":"b"}}', '{"search_queries":[null]}']
    df = spark.createDataFrame([(i, "q", r) for i, r in enumerate(raw)], "plan_id int, question string, raw string")
    assert [r.search_queries for r in op.parse_query_plans(df).orderBy("plan_id").collect()] == [["a", "d"], ["q"], ["q"], ["q"], ["q"]]
