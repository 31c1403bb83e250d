import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import oracles, topk
from gleaner.llm.queries import op3_pivot_topk


def brute(rows, k):
    """rows: (id, vector of whole numbers or None)."""
    out = []
    good = [(i, v) for i, v in rows if v is not None]
    for q, v in sorted({(i, tuple(v)) for i, v in good}):
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, vector array<long>, score string, rank int")
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect()))


@pytest.mark.parametrize(("spread", "dims"), [(256, 8), (3, 4), (1, 3), (0, 2)])
def test_brute_force_with_ties(spark, spread, dims):
    rng = np.random.default_rng(spread)
    rows = [(i, rng.integers(-spread, spread + 1, dims).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in (400, 450, 500, 501)]  # copies of a query, some of them queries
    assert run(spark, rows) == brute(rows, 5)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 256)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-9, 10, 6).tolist()) for i in range(1100)]
    assert run(spark, rows) == brute(rows, 5)


def clustered(rng, clusters, each, dims):
    x = np.concatenate([rng.integers(-5, 6, (each, dims)) + c for c in rng.integers(-800, 800, (clusters, dims))])
    return [(i, v) for i, v in enumerate(x[rng.permutation(len(x))].tolist())]


def test_pivots_eliminate(spark):
    """On clustered vectors few candidates are scored, and the result is still exact."""
    rows = clustered(np.random.default_rng(1), 20, 150, 16)
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    assert topk.scored_share(df, F.col("vec_id") % 50 == 0, 5) < 0.2
    assert run(spark, rows) == brute(rows, 5)


def test_blocks_are_left_out(spark, monkeypatch):
    """With thresholds from the nearest blocks, queries meet few of the others."""
    monkeypatch.setattr(topk, "CANDIDATES", 256)
    monkeypatch.setattr(topk, "QUERIES", 8)
    sent, made = [], []
    whole = topk._compared
    monkeypatch.setattr(topk, "_compared", lambda pairs, asks, blocks, *more: sent.append(pairs.count()) or made.append(asks.count() * blocks.count()) or whole(pairs, asks, blocks, *more))
    rows = clustered(np.random.default_rng(2), 12, 250, 12)
    assert run(spark, rows) == brute(rows, 5)
    assert sum(sent) < 0.5 * made[0]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for dims, n in ((4, 50), (40, 30), (64, 300)):
        x = rng.integers(-300, 300, (n, dims)).astype(float)
        table = topk.Table.of(topk._choose(x, topk.pivots_for(dims)))
        t = table.rows(x)
        assert (t @ t.T >= x @ x.T - 1e-6 * np.abs(x).max() ** 2 * dims).all()


def test_repeated_blocks(spark):
    """Wholly equal blocks of candidates are candidates as often as they occur."""
    rows = [(50, [1, 2])] + [(7, [3, 4])] * 700 + [(8, [1, 1])] * 3
    assert run(spark, rows) == brute(rows, 5)


def test_large_numbers(spark):
    rows = [(i, [2**25 * (i - 3), i]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5)


def test_integral(spark):
    vectors = [[0.5, -0.001], None, [1.0, None], [math.nan, 1.0], [math.inf, 0.0], []]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    assert [r[0] for r in df.select(topk.integral(F.col("v"))).collect()] == [[128, -1], None, None, None, None, []]


def test_odd(spark):
    rows = [(0, [1, 2]), (1, None), (2, [3, 4]), (50, None), (100, [0, 0]), (2, [3, 4]), (0, [1, 2])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == [] and run(spark, [(1, [1])]) == []
    with pytest.raises(Exception, match="dimension"):
        run(spark, [(0, [1, 2]), (1, [1])])


def test_query(spark, sf, oracle, same):
    same(oracle(oracles.OP3), op3_pivot_topk(spark, sf).toPandas())
