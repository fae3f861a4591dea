import re

import numpy as np
import pytest
import xxhash
from samples import no_docs, odd_docs, prose

from opinarium.llm import components, simhash


def brute(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def clustered(n):
    rng = np.random.default_rng(3)
    out = []
    while len(out) < n:
        p = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(rng.integers(1, 12))):
            out.append(p)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                p ^= 1 << int(bit)
    return list(dict.fromkeys(out[:n]))


def test_links_join_what_brute_force_joins(spark):
    prints = clustered(1500)
    df = spark.createDataFrame([(signed(p),) for p in prints], "_print bigint").repartition(5)
    for cell_rows in (1024, 3):  # also with crowded cells
        joined = {r.node: r.root for r in components.components(simhash.near_links(df, cell_rows=cell_rows)).collect()}
        got = {}
        for p in prints:
            got.setdefault(joined.get(signed(p), signed(p)), set()).add(p)
        want = {}
        for p, r in zip(prints, brute(prints)):
            want.setdefault(r, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_dense_cell(spark):
    base = 0x5A5A5A5A5A5A5A5A
    prints = [base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    df = spark.createDataFrame([(signed(p),) for p in prints], "_print bigint")
    links = simhash.near_links(df, cell_rows=50)
    assert links.count() < 60 * len(prints)  # of some two million pairs within three bits
    assert components.components(links).select("root").distinct().count() == 1


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.near_copies(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].fingerprint == by_id[2].fingerprint == "0" * 16 and by_id[2].component_id == 0
    assert by_id[5].component_id == 4 and by_id[10].component_id == 9
    assert {r.component_id for r in got if r.doc_id is None} == {0, 6}
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({r.component_id for r in got})
    assert simhash.near_copies(no_docs(spark)).count() == 0 and simhash.without_near_copies(no_docs(spark)).count() == 0


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 1)], "u bigint, v bigint")
    got = components.components(df).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO three", prose(4, 90), "é ñ 漢字 🎉 x y É", "a a a a a a", "A\tB\x0bC D e f"])
def test_every_bit_of_a_fingerprint(text):
    """Bits counted one by one over all shingles, repeats included."""
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if bits[b])
