import re

from samples import no_docs, odd_docs

from opinarium.llm import quality

SPACE = re.compile(r"[ \t-\r]+")


def brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else set()
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
    )


def test_measurements_match_brute_force(spark):
    docs = odd_docs(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.ledger(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None and len(texts[r.doc_id] or "") < 5000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_policies_and_ablations(spark):
    rows = quality.ledger(odd_docs(spark)).cache()
    policy = quality.POLICIES[quality.CURRENT]
    bits = [r.failed for r in rows.collect()]
    got = {r.rule: (r.failing, r.alone) for r in quality.ablations(rows, policy).collect()}
    for rule in policy.rules:
        bit = quality.bit(rule)
        assert got[rule] == (sum(b & bit > 0 for b in bits), sum(b & policy.mask == bit for b in bits))
    assert rows.filter(quality.verdict(policy)).count() == sum(b & policy.mask == 0 for b in bits)
    assert {r.doc_id for r in rows.filter("failed & 1 = 1").collect()} >= {0, 1, 2, 3}


def test_no_python_and_no_rows(spark):
    plan = quality.ledger(no_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert quality.ledger(no_docs(spark)).count() == 0
