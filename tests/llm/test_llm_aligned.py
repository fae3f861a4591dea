import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import no_docs, odd_docs, prose
from tokenizers import Tokenizer

from opinarium.llm import aligned

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
GIVEN = aligned.read_tokenizers(JSON, MODEL, public_tokenizers.PATTERN)
A = Tokenizer.from_file(JSON)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SIGNS = aligned._byte_signs()
ODD = ["", "▁x", "a  b\n\n c", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00 � é é ａ 漢字 🎉🎉", " ", "\t", "1234567 don't", "x" * 3000]


def groups_of(text):
    """Groups of token lists by walking both sides, with the library that the file belongs to; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(SIGNS[s] for s in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([i - 3]) if 3 <= i < 259 else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    out, i, j = [], 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        la, lb = len(a_bytes[i]), len(b_bytes[j])
        while la != lb:
            if la < lb:
                i += 1
                left.append(a[i])
                la += len(a_bytes[i])
            else:
                j += 1
                right.append(b[j])
                lb += len(b_bytes[j])
        out.append((left, right))
        i, j = i + 1, j + 1
    assert j == len(b)
    return out


def brute(rows):
    """Rows (doc_id, text) to the sorted result."""
    cut = {text: groups_of(text) for _, text in rows}
    links = {t: Counter((x, y) for left, right in g or () for x in left for y in right) for t, g in cut.items()}
    counts = Counter(pair for _, t in rows for pair in links[t])
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for i, t in rows:
        g = cut[t] or []
        line = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        own = links[t]
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in own.items()),
            hashlib.sha256(line.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [aligned.FREQUENT, 5, 0])
def test_odd_rows(spark, frequent):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    docs = odd_docs(spark).select("doc_id", "text").unionByName(extra)
    got = aligned.aligned_documents(docs, GIVEN, frequent)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows(spark):
    assert aligned.aligned_documents(no_docs(spark), GIVEN).collect() == []


def test_copies_are_tokenised_once_and_counted(spark):
    rows = [(i, "hot words here" if i % 3 else prose(i % 20, 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    texts = aligned.align_texts(docs, GIVEN)
    assert texts.count() == len({t for _, t in rows}) and texts.agg({"copies": "sum"}).first()[0] == 300
    got = aligned.aligned_documents(docs, GIVEN, 30)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_wide_groups_count_the_same(monkeypatch):
    a, b = np.array([5, 6, 5, 7, 7]), np.array([1, 1, 2])
    args = a, b, np.array([0, 0, 0, 1, 1]), np.array([3, 2]), np.array([2, 1])
    listed = aligned._pairs(*args)
    monkeypatch.setattr(aligned, "WIDE", 0)
    assert all((x == y).all() for x, y in zip(listed, aligned._pairs(*args)))
    assert dict(zip(listed[0].tolist(), listed[1].tolist())) == {5 << 32 | 1: 4, 6 << 32 | 1: 2, 7 << 32 | 2: 2}


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    own = aligned.Aligner(GIVEN) if not hasattr(test_any_text, "own") else test_any_text.own
    test_any_text.own = own
    n_a, n_b, n_groups, n_links, digest, pairs, links = own.align(text)
    [(_, *want)] = brute([(0, text)])
    assert [n_a, n_b, n_groups, n_links, digest] == want[:4] + want[6:]
    assert links.sum() == n_links and (np.diff(pairs) > 0).all()


def test_long_words():
    own = aligned.Aligner(GIVEN)
    for text in ("ab" * 300_000, "漢" * 100_000, " " * 100_000):
        n_a, n_b, n_groups, n_links, *_ = own.align(text)
        assert min(n_a, n_b) >= n_groups > 0 and n_links >= n_groups
