"""Hard negatives against plain Python; intervals against exact products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postings_engine.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_mine(rows, each=100):
    part = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        key = (label, [float(np.float32(x)) for x in vector])
        part[vec_id] = min(part.get(vec_id, key), key)
    part = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in part.items()}
    out = []
    for anchor, (label, q) in part.items():
        if anchor % each:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, other) for i, (other, v) in part.items() if len(v) == len(q))
        for p, positive, _ in [s for s in scored if s[2] == label and s[1] != anchor][:5]:
            fits = [(n, i) for n, i, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(anchor, positive, k, i, -p, -n) for k, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def cloud(n, d=64, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d))
    rows = []
    for i in range(n):
        label = int(rng.integers(10))
        v = centres[label] * 0.6 + rng.normal(size=d)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], label))
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_mine(spark, block_bytes):
    rows = cloud(600)
    rows += [(1000 + k, rows[k][1], rows[(k + 1) % 9][2]) for k in range(120)]  # ties under other labels
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2001, [None] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [float("inf")] * 64, 2),
             (2004, rows[0][1], None), (2100, [0.0] * 64, 3), (2200, [], 3), (2201, [], 4), (2300, [0.5, 0.5], 3), (2301, [0.5, 0.5], 3), (2302, [0.3, 0.1], 5),
             (5, rows[9][1], 0), (5, rows[8][1], 0), (2400, [-x for x in rows[0][1]], 7)]
    table = spark.createDataFrame(rows, VECTORS).repartition(5).selectExpr("*", "1 AS rank", "2 AS place", "3 AS norm")
    got = sorted(tuple(r) for r in hn.mine(table, block_bytes=block_bytes).collect())
    assert got == plain_mine(rows)
    assert len(got) > 200


def test_large_components_and_empty(spark):
    rows = [(i, [1e30 * ((i * 37) % 13 - 4), float(i)], i % 3) for i in range(0, 400, 5)]
    got = sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert all(abs(r[4]) <= 2 ** 63 - 1 for r in got)
    exact = [(i, [v[0] / 1e26, v[1]], label) for i, v, label in rows]
    assert sorted(tuple(r) for r in hn.mine(spark.createDataFrame(exact, VECTORS)).collect()) == plain_mine(exact)
    assert hn.mine(spark.createDataFrame([], VECTORS)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(0, 10 ** 6), st.sampled_from([1e-3, 1.0, 50.0]))
def test_intervals_hold(d, seed, spread):
    rng = np.random.default_rng(seed)
    x, q = (np.floor(256 * spread * rng.normal(size=(n, d))) for n in (40, 7))
    q[0], x[0], x[1] = 0.0, 0.0, q[1]
    anchors = hn.Anchors(np.arange(7), np.zeros(7), q)
    lower, upper = anchors.interval(np.arange(7), *hn.encode(x))
    exact = q @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(-10, 10 ** 9))
def test_window(p, n):
    low, high = hn.window(np.int64(p))
    assert (low <= n <= high) == (30 * p <= 100 * n <= 90 * p)


def test_dots_beyond_doubles():
    x, y = np.array([[2.0 ** 40, 3.0], [2.0 ** 300, 1.0]]), np.array([[2.0 ** 20, 1.0], [-(2.0 ** 40), 0.0]])
    assert hn.dots(x, y).tolist() == [[2 ** 60 + 3, -(2 ** 63)], [2 ** 63 - 1, -(2 ** 63)]]
