"""Quantiles by refined ranges against numpy."""

import numpy as np
import pytest

from tidegrid.operators import quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("ranges", [16, 1024])
def test_quantiles(spark, ranges):
    rng = np.random.default_rng(ranges)
    groups = {
        ("a", 1): rng.normal(size=500), ("a", 2): np.repeat([3.0, 7.0], 40), ("a", None): rng.integers(0, 5, 200).astype(float), (None, 1): [4.25],
        ("b", 1): rng.lognormal(0, 9, 300), ("b", 2): [-0.0, 0.0, 1e-300, 5e-324, -1e100], ("c", 3): np.full(100, 2.5), ("d", 4): [1.0, 1.0 + 2**-52, 1.0 + 2**-51],
    }
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("a", 1, None), ("a", 1, float("nan")), ("empty", 0, None)]
    df = spark.createDataFrame(rows, "name string, n int, x double")
    got = {(r.name, r.n, r.share): r.value for r in quantiles.quantiles(df, "x", SHARES, ("name", "n"), ranges).collect()}
    assert got == {(*k, s): pytest.approx(float(np.quantile(np.asarray(v, float), s)), rel=1e-12) for k, v in groups.items() for s in SHARES}


def test_without_groups(spark):
    df = spark.range(1001).selectExpr("CAST(id AS INT) AS v")
    assert {r.share: r.value for r in quantiles.quantiles(df, "v", (0.5, 0.9995)).collect()} == {0.5: 500.0, 0.9995: pytest.approx(999.5)}
    assert quantiles.quantiles(df.limit(0), "v", (0.5,)).count() == 0
    assert [tuple(r) for r in quantiles.wide(quantiles.quantiles(df, "v", (0.25, 0.5)), (), {0.25: "q", 0.5: "m"}).collect()] == [(250.0, 500.0)]
