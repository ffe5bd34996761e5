"""Spectra, sweeps, zoomed rasters, plain clusters, recorded searches and traced masks on hand-made input."""

from collections import deque

import numpy as np
import pytest
from test_operators import grid, pixels

from tidegrid.operators import kernels, labels, raster, routes, spectra
from tidegrid.plans import sweep_queries, tables


def holey(seed=0, shape=(20, 24)):
    a = np.random.default_rng(seed).normal(size=shape)
    a[np.random.default_rng(seed + 1).random(shape) < 0.3] = np.nan
    return a


def test_sweep_is_one_call_a_value(spark):
    a = holey()
    t = raster.to_tiles(pixels(spark, a), *a.shape)
    got = spectra.sweep(t, lambda x, v: (np.nanmean(x) * v, np.nan), "k", (1, 2, 3), ("m", "none"))
    assert [(r.cell, r.cdi, r.k, round(r.m, 9), r.none) for r in got.orderBy("k").collect()] == [(0, 0, k, round(float(np.nanmean(a) * k), 9), None) for k in (1, 2, 3)]


def test_sweep_of_nothing(spark):
    t = raster.to_tiles(pixels(spark, np.zeros((2, 2))).where("false"), 2, 2)
    assert spectra.sweep(t, lambda x, v: (1.0,), "k", (1,), ("m",)).count() == 0


def test_stages_of_filling():
    a = holey()
    s = spectra.fill_stages(a)
    ok = np.isfinite(a)
    assert all(np.array_equal(x[ok], a[ok]) and np.isfinite(x).all() for x in s.values())
    r, c = np.argwhere(~ok)[0]
    d = [((r - i) ** 2 + (c - j) ** 2, a[i, j]) for i, j in np.argwhere(ok)]
    assert s["nearest"][r, c] in [v for k, v in d if k == min(d)[0]]
    assert not any(x.any() for x in spectra.fill_stages(np.full((3, 3), np.nan)).values())


@pytest.mark.parametrize("how", ["none", "half", "whole", "power"])
@pytest.mark.parametrize("window", [None, "hann", "hamming", "tukey"])
def test_transform_and_back(how, window):
    a = np.nan_to_num(holey(3))
    f = spectra.transformed(a, window, how)
    assert f.shape == {"none": (20, 24), "half": (44, 48), "whole": (60, 72), "power": (32, 32)}[how]
    assert np.allclose(spectra.restored(f, a.shape, how, window), a)


def test_padding_repeats_the_tile_up_to_a_power_of_two():
    a = np.arange(15.0).reshape(3, 5)
    back = np.fft.ifft2(np.fft.ifftshift(spectra.transformed(a, None, "power"))).real
    want = [[a[(r - 0) % 3, (c - 1) % 5] for c in range(8)] for r in range(4)]
    assert np.allclose(back, want)
    with pytest.raises(ValueError):
        spectra.padding((3, 3), "other")


def test_low_pass_is_a_sum_of_low_waves():
    y, x = np.mgrid[:32, :32]
    low, high = np.cos(2 * np.pi * 2 * x / 32), np.sin(2 * np.pi * 9 * y / 32)
    assert np.allclose(spectra.low_passed(5 + low + high, 4), 5 + low)


def test_notches():
    line, cross = spectra.axis_notch((20, 30), 2, False), spectra.axis_notch((20, 30), 2)
    assert line.sum() == 4 * 30 - 16 and cross.sum() == 4 * 30 + 4 * 20 - 2 * 16
    g = spectra.gaussian_notch((5, 101))
    assert g[0, 50] == 0 and g[0, 52] == pytest.approx(1 - np.exp(-0.5)) and g.min(axis=0)[0] > 0.999
    c = spectra.cone((41, 41), 0.0)
    assert c[20, 40] and c[20, 0] and c[24, 40] and not c[30, 30] and not c[40, 20]
    assert (spectra.cone((41, 41), 90.0) == c.T).all()


@pytest.mark.parametrize("turn", [0, 30, 60, 90, 140])
def test_stripes_are_found(turn):
    y, x = np.mgrid[:50, :50]
    t = np.radians(turn)
    a = np.sin((x * np.cos(t) + y * np.sin(t)) * 2 * np.pi / 5)
    off = abs(spectra.cone_angle(a)[0] - turn) % 180
    assert min(off, 180 - off) <= 10
    off = abs(spectra.cross_angle(a, width=1.0)[0] - turn) % 90
    assert min(off, 90 - off) <= 5


def test_trend_and_residual_add_up():
    a = holey(5)
    trend, rest = spectra.detrended(a, 3.0)
    assert np.allclose(trend + rest, kernels.filled(a)) and np.allclose((trend + rest)[np.isfinite(a)], a[np.isfinite(a)])


@pytest.mark.parametrize("k", [1, 2, 3])
def test_zoom(spark, k):
    a = np.nan_to_num(holey(7, (6, 5)))
    got = np.nan_to_num(grid(raster.zoomed(pixels(spark, a), k, 6, 5), (6 * k, 5 * k)))
    rows, cols = (np.linspace(0, n - 1, n * k) for n in a.shape)
    along = np.array([np.interp(cols, np.arange(5), r) for r in a])
    want = np.array([np.interp(rows, np.arange(6), c) for c in along.T]).T
    assert np.allclose(got, want)


def test_plain_clusters(spark):
    r = np.random.default_rng(0)
    at = np.concatenate([r.normal(5, 0.1, (40, 2)), r.normal(0, 0.1, (60, 2))])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in at] + [(None, 1.0)], "x double, y double")
    got = labels.plain_clusters(df, ["x", "y"]).collect()
    assert len(got) == 100 and all(row.cluster == int(row.x > 2) for row in got)


def steps_by_queue(cells, start, goal):
    """Steps of a shortest way by a plain queue; None if there is none."""
    near = lambda p: min(sorted(cells), key=lambda c: (c[0] - p[0]) ** 2 + (c[1] - p[1]) ** 2)
    a, b = near(start), near(goal)
    far, queue = {a: 0}, deque([a])
    while queue:
        r, c = queue.popleft()
        for n in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if n in cells and n not in far:
                far[n] = far[(r, c)] + 1
                queue.append(n)
    return far.get(b)


def test_traced_masks(spark):
    r = np.random.default_rng(2)
    masks = {i: {(int(a), int(b)) for a, b in np.argwhere(r.random((9, 9)) < 0.25 + 0.05 * i)} for i in range(10)}
    df = spark.createDataFrame([(i, a, b) for i, m in masks.items() for a, b in m for _ in range(2)], "run_id long, row int, col int")
    got = {}
    for x in routes.traced(df, (0, 0), (8, 8)).orderBy("run_id", "step").collect():
        got.setdefault(x.run_id, []).append((x.row, x.col))
    assert {i: len(w) - 1 for i, w in got.items()} == {i: n for i, m in masks.items() if (n := steps_by_queue(m, (0, 0), (8, 8))) is not None}
    assert len(got) not in (0, 10)
    for i, w in got.items():
        assert set(w) <= masks[i] and all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(w, w[1:]))
    assert routes.trace(np.zeros((0, 2), int), (0, 0), (1, 1)) == [] and routes.trace(np.array([[3, 4]]), (0, 0), (9, 9)) == [(3, 4)]


def test_recorded_search(spark):
    a = np.random.default_rng(4).uniform(1, 9, (12, 12))
    maps = pixels(spark, a).selectExpr("5L AS run_id", "row", "col", "v")
    seen = routes.searches(maps, 12, 12, (0, 0), (11, 11), momentum=2).orderBy("step").collect()
    way = routes.routes(maps, 12, 12, (0, 0), (11, 11), momentum=2).orderBy("step").collect()
    assert [x.step for x in seen] == list(range(len(seen))) and (seen[0].row, seen[0].col, seen[0].g) == (0, 0, 0.0)
    assert (seen[-1].row, seen[-1].col, seen[-1].g) == (11, 11, way[-1].g)
    assert {(x.row, x.col, x.heading, x.g) for x in way} <= {(x.row, x.col, x.heading, x.g) for x in seen}
    estimate = [x.g + np.hypot(x.row - 11, x.col - 11) * a.min() for x in seen]
    assert all(p <= q + 1e-9 for p, q in zip(estimate, estimate[1:]))


def test_scenarios(spark, sf):
    got = {(r.cell, r.scenario): r for r in sweep_queries.scenario_costs(spark, sf).collect()}
    px = raster.combine(tables.pixels(spark, sf), "mean").where("cell = 1").collect()
    a = np.full((50, 50), 100.0)
    for r in px:
        a[r.row, r.col] = r.v
    shut = (a >= 60) & (a <= 99)
    shut[sweep_queries.START] = shut[sweep_queries.GOAL] = False
    for scenario, cost in ((0, a), (1, np.where(shut, -1.0, a))):
        way = routes.cheapest(cost, sweep_queries.START, sweep_queries.GOAL, 1, 2)
        assert (got[(1, scenario)].steps, got[(1, scenario)].cost) == (len(way), pytest.approx(way[-1][3], abs=1e-5))
    proposed = sum(a[i, i] for i in range(3, 46)) * 2**0.5 + a[46, 45]
    assert got[(1, 0)].proposed == pytest.approx(proposed, abs=1e-5)
    assert got[(1, 0)].reduction == pytest.approx(100 * (1 - got[(1, 0)].cost / proposed), abs=1e-4)


def test_tiles_from_few_and_many_pixels(spark):
    whole, sparse = np.random.default_rng(1).normal(size=(7, 9)), np.full((7, 9), np.nan)
    first, last = sparse.copy(), sparse.copy()
    first[0, 0], last[6, 8], sparse[3, 4], sparse[3, 5] = 1.0, 2.0, 3.0, 4.0
    given = [whole, first, last, sparse, holey(9, (7, 9))]
    df = pixels(spark, given[0])
    for i, a in enumerate(given[1:], 1):
        df = df.union(pixels(spark, a, cell=i))
    for r in raster.to_tiles(df, 7, 9).collect():
        got = np.array([np.nan if v is None else v for v in r.data]).reshape(r.h, r.w)
        assert np.array_equal(got, given[r.cell], equal_nan=True)
