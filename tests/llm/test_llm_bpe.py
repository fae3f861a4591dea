import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import no_docs, odd_docs

from opinarium.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library(codec, text):
    text = text.encode("utf-8", "replace").decode()
    assert codec.encode(text) == LIBRARY.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_merges_that_defeat_longest_matches(codec):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "aa", "the", "ing", "er", " ", "  ", "\n", "é", "ß", "'s", "1", "!"]) for _ in range(rng.randint(1, 25)))
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)
    for text in ("a" * 20_000, "ab" * 5000, "é" * 3000):
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)


def test_a_full_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    small = bpe.Codec(RANKS, P.PATTERN)
    text = "some quite different words, one after another, and again some quite different words"
    assert small.encode(text) == LIBRARY.encode_ordinary(text) and len(small.chunks) <= 3


def test_documents(spark):
    docs = odd_docs(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    rows = bpe.token_digests(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            ids = LIBRARY.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = bpe.encode_documents(docs, RANKS, P.PATTERN)
    for r in bpe.decode_documents(encoded, RANKS).filter("doc_id is not null").collect():
        assert bytes(r.bytes).decode() == texts[r.doc_id]
    assert bpe.token_digests(no_docs(spark), RANKS, P.PATTERN).count() == 0
