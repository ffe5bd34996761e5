"""Exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, row string, x string, low int"


def brute(rows, k, every):
    use = [(n, i, [int(np.floor(256.0 * t)) for t in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(t is not None and np.isfinite(t) for t in v)]
    out = []
    for n, i, v in use:
        if i % every == 0:
            s = sorted((-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(v, w)))), j) for m, j, w in use if m != n and len(w) == len(v))[:k]
            out.append((i, [(r, j, -t) for r, (t, j) in enumerate(s, 1)]))
    return sorted(x for x in out if x[1])


def found(spark, rows, k, every, **more):
    df = spark.createDataFrame([(i, v, 1, "r", "x", 0) for i, v in rows], SCHEMA)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % every == 0, k, **more).orderBy("query", "rank").collect():
        got.setdefault((r.query, r.query_id), []).append((r["rank"], r.vec_id, r.score))
    return sorted((i, v) for (_, i), v in got.items())


BAD = [(900, None), (950, [None] + [1.0] * 7), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1150, []), (1200, []), (1101, [3.0, -2.0])]


@pytest.mark.parametrize("k, block, ranges", [(5, 8192, 4096), (3, 40, 4), (7, 64, 16)])
def test_against_brute_force(spark, monkeypatch, k, block, ranges):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", max(2, block // 16))
    rng = np.random.default_rng(k)
    x = np.round(rng.normal(size=(300, 8)), 1)  # many ties
    x[100:200] = x[100]
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(50, x[50].tolist()), (50, x[51].tolist()), (100, x[100].tolist())]
    assert found(spark, rows, k, 50, ranges=ranges) == brute(rows, k, 50)


def test_large_numbers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * 10.0 ** rng.integers(-2, 9, (60, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, [1e300, 1.0, -1e300]), (61, [1e300, 0.0, 0.0]), (62, [-1e300, 5e-324, 0.0])]
    want = brute([(i, v if max(map(abs, v)) < 1e300 else [float(np.clip(t, -(2**63 - 1) // 256, (2**63 - 1) // 256)) for t in v]) for i, v in rows], 5, 10)
    got = found(spark, rows, 5, 10)
    near = [i for i in range(0, 60, 10)]
    assert [g for g in got if g[0] in near and all(j < 60 for _, j, _ in g[1])] == [w for w in want if w[0] in near and all(j < 60 for _, j, _ in w[1])]
    assert [len(v) for _, v in got] == [5] * 7


def test_few_and_none(spark):
    assert found(spark, [], 5, 50) == []
    assert found(spark, [(0, [1.0, 2.0])], 5, 50) == []
    assert found(spark, [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.5])], 5, 50) == [(0, [(1, 1, 0), (2, 2, 0)])]


def test_counts_of_ranges():
    s = np.array([[9, 1, 5, 5, 0], [3, 3, 3, 3, 3]])
    row, at, n = topk.range_counts(s, np.array([0, 0]), np.array([4095, 4095]), np.array([2, 9]), np.ones((2, 5), bool))
    assert list(zip(row.tolist(), at.tolist(), n.tolist())) == [(0, 9, 1), (0, 5, 2), (1, 3, 5)]
