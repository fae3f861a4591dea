import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import WORDS, no_docs, odd_docs

from opinarium.llm import toxicity

def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[a]}{WORDS[b][:3]}" for a, b in rng.integers(0, 20, (n, 2)))


INSULTS = ("blockhead", "numskull", "dimwit")


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, prose(i, 60) + (f" {INSULTS[i % 3]} " + prose(i + 1, 20) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return docs, toxicity.train_machine(docs, docs.select("doc_id", "toxic"))


def test_finds_insults_and_leaves_the_rest(spark, trained):
    _, machine = trained
    new = [(i, prose(900 + i, 80) + (f" {INSULTS[i % 3]}" if i % 2 else ""), i % 2) for i in range(200)]
    docs = spark.createDataFrame(new, "doc_id bigint, text string, toxic int")
    scored = toxicity.toxicity(docs, machine, F.struct("toxic")).select("_row.toxic", "score").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in scored]) > 0.95
    assert toxicity.without_toxic(docs, machine).filter("toxic = 0").count() >= 95


def test_gaps_and_inserted_signs(trained):
    _, machine = trained
    for text in ("b-l-o-c-k-h-e-a-d", "n.u.m.s.k.u.l.l", "blockxhead", "NUM5KULL", "x d i m w i t"):
        assert machine.strengths(text).max() > 0, text
    for text in ("alphabet gammazet", "", "漢字 é", "x" * 300_000):
        assert machine.strengths(text).max() < 0.5, text[:20]


def test_a_long_text_is_scored_whole(trained):
    _, machine = trained
    text = prose(3, 60_000) + " blockhead " + prose(4, 60_000)
    parts = machine.strengths(text)
    assert parts.max() > 0.5 and len(parts) >= 110_000


def test_odd_rows_and_nothing_to_learn(spark, trained):
    _, machine = trained
    docs = odd_docs(spark)
    assert toxicity.toxicity(docs, machine, F.struct("doc_id")).filter("score between 0 and 1").count() == docs.count()
    assert toxicity.without_toxic(docs, machine).columns == docs.columns
    none = toxicity.train_machine(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.toxicity(docs, none, F.struct("doc_id")).filter("score >= 0.5").count() == 0
    assert toxicity.without_toxic(no_docs(spark), none).count() == 0


def test_parts_of_long_words_hold_every_short_piece():
    word = np.arange(1, 28, dtype=np.int8)[np.arange(333) % 26]
    kinds = np.r_[0, word[:5], 0, word, 0, word[:40], 0].astype(np.int8)
    parts = "".join(map(chr, toxicity._parted(kinds) + 64)).strip("@").split("@")
    line = "".join(map(chr, word + 64))
    assert parts[0] == line[:5] and parts[-1] == line[:40] and max(map(len, parts)) == toxicity.LONGEST
    for at in range(len(line) - toxicity.STRIDE + 1):
        assert any(line[at : at + toxicity.STRIDE] in part for part in parts)
    assert all(part in line for part in parts)


@pytest.mark.parametrize("filler", ["q", "漢", "Zm9vYmFy", "é"])
def test_words_of_a_million_letters_are_read_whole(trained, filler):
    _, machine = trained
    plain = filler * (1_000_000 // len(filler))
    assert machine.strengths(plain).max() < 0.5
    half = plain[: len(plain) // 2 // len(filler) * len(filler)]
    for text in ("blockhead" + plain, plain + "numskull", half + "blockhead" + half):
        assert machine.strengths(text).max() > machine.strengths(plain).max() + 0.3, filler


def test_long_words_as_rows(spark, trained):
    _, machine = trained
    texts = ["x" * 630_000, "漢" * 800_000, "ab" * 200_000 + " blockhead", "-" * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, machine, F.struct("doc_id")).select("_row.doc_id", "score").collect()}
    assert len(got) == 4 and all(0 <= s <= 1 for s in got.values())


def test_kernel_against_enumeration():
    """Common subsequences of four letters within six places, borders included, counted one by one."""
    from itertools import combinations

    def weights(word):
        out = {}
        for places in combinations(range(len(word)), 4):
            span = places[-1] - places[0]
            if span < 6:
                key = tuple(word[i] for i in places)
                out[key] = out.get(key, 0.0) + toxicity.SKIP ** (span - 3)
        return out

    words = ["blockhead", "blockxhead", "numskull", "headblock", "bloc", "abc", "aaaaaaa"]
    for left in words:
        for right in words:
            a, b = ("".join(map(chr, toxicity.letters_of(w)[1:-1] + 64)) for w in (left, right))
            sums = []
            for f in (a, b):
                hashes, w = toxicity.fragment_features(f)
                table = np.zeros(1 << toxicity.BITS)
                np.add.at(table, hashes, w * np.sqrt(len(f) + 2))
                sums.append(table)
            wa, wb = weights(f"@{a}@"), weights(f"@{b}@")
            assert sums[0] @ sums[1] == pytest.approx(sum(w * wb.get(k, 0.0) for k, w in wa.items()))
