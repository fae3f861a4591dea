import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinarium.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, v string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)


def brute(rows, n_pos=5, n_neg=3, low=50, high=95, every=50):
    """All rows against all anchors, in plain integers."""
    rows = [(i, x, [math.floor(256 * float(np.float32(c))) for c in v]) for i, x, v in rows
            if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), i, x) for i, x, w in rows if i != a]
        for negated, pos, _ in sorted(s for s in scored if s[2] == label)[:n_pos]:
            score = -negated
            fit = sorted(s for s in scored if s[2] != label and low * score <= -100 * s[0] <= high * score)[:n_neg]
            out += [(a, pos, n + 1, i, score, -s) for n, (s, i, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **options):
    return sorted(map(tuple, negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0, **options).collect()))


def clustered(n, dims, centres, spread, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    of = rng.integers(centres, size=n)
    v = middle[of] + spread * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), int(rng.integers(4)), x) for i, x in enumerate(v.astype(np.float32).tolist())], of


@pytest.mark.parametrize("sizes", [(512, 64, 1024), (16, 3, 4)])
def test_against_all_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "PAGE", "LANE"), sizes):
        monkeypatch.setattr(negatives, name, size)
    rows, _ = clustered(600, 12, 9, 0.4)
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want
    assert found(spark, rows, positives=2, negatives=1, low=20, high=80) == brute(rows, 2, 1, 20, 80)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 8)
    inf, nan = float("inf"), float("nan")
    hot = [0.5, -0.25, 0.125]
    rows = [(i, i % 3, hot) for i in range(0, 150)]  # one vector, ties everywhere
    rows += [(200, 1, None), (250, None, hot), (None, 1, hot), (300, 1, [nan, 0.0, 1.0]), (350, 1, [inf, 0.0, 0.0]), (400, 1, [None, 0.0, 0.0])]
    rows += [(450, 2, [0.4, -0.2, 0.1]), (451, 1, [0.4, -0.2, 0.1]), (500, 0, [0.0, 0.0, 0.0]), (501, 0, [-1.0, 1.0, 1.0])]
    rows += [(550, 2, [300.0, -2.5, 7.0]), (551, 2, [0.3]), (600, 2, []), (601, 3, [])]
    assert found(spark, rows) == brute(rows)
    repeated = rows[:60] + [rows[0], rows[50], rows[7]] + rows[-4:]
    assert found(spark, repeated) == brute(repeated)


def test_nothing_to_find(spark):
    assert found(spark, []) == [] and found(spark, [(50, 1, [1.0])]) == [] and found(spark, [(1, 1, [1.0]), (2, 2, [0.9])]) == []
    assert found(spark, [(50, 1, []), (51, 1, []), (52, 2, [])]) == [(50, 51, 1, 52, 0, 0)]


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(np.float32(x)) for x in rng.normal(size=3) * 2e6 + 1e6]) for i in range(120)]
    assert found(spark, rows) == brute(rows)


def test_blocks_are_skipped(spark, monkeypatch):
    """Anchors of tight clusters ask for a part of the blocks only, and the bounds hold for every row."""
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rows, _ = clustered(3000, 6, 12, 0.05)
    p = negatives.Prepared(frame(spark, rows), F.col("vec_id") % 50 == 0, 5, 50, 95)
    asked = negatives.asked_blocks(p).collect()
    wanted = sum(int(np.unpackbits(np.frombuffer(bytes(r.wanted), np.uint8)).sum()) for r in asked)
    assert 0 < wanted < 0.6 * p.blocks.count() * 60
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    """In order of their keys, all cells follow one another one step apart."""
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = negatives.curve_keys(cells, bits)
    path = cells[np.lexsort(keys.T[::-1])]
    assert len(np.unique(keys, axis=0)) == len(cells) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_vectors_do_not_meet_in_one_task(spark):
    """One vector in all rows still fills every partition."""
    rows = frame(spark, [(i, 1, [1.0, 2.0]) for i in range(4000)])
    usable = negatives._usable(rows)
    shape = negatives.Shape(usable)
    coded = negatives._coded(usable, shape, F.col("vec_id") % 50 == 0)
    parts = coded.repartitionByRange(4, "key", "vec_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000
