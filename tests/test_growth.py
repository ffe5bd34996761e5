"""Steps whose work must not outgrow their input: searches of all states at once, tiles in place, cells of routes, hulls before the shuffle."""

import heapq
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegrid.operators import crossings, focal, labels, raster, routes, vector
from tidegrid.plans import map_queries, tables


def settled_in_turn(cost, start, goal, momentum):
    """The way and the states by a heap: every map counts as one on which a step may keep the estimate."""
    with pytest.MonkeyPatch.context() as m:
        m.setattr(routes, "_rising", lambda *_: False)
        states = []
        return routes.cheapest(cost, start, goal, 1, momentum, settled=states), states


def test_states_are_found_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    for k in range(12):
        cost = rng.uniform(1, 100, (14, 17))
        cost[rng.random(cost.shape) < 0.3] = 100.0 if k % 2 else -1.0
        cost[0, 0] = cost[11, 15] = 50.0
        cost[13, 0] = 0.9  # the least cost, off the goal's rows, columns and diagonals
        momentum = k % 3 + 1
        want, order = settled_in_turn(cost, (0, 0), (11, 15), momentum)
        with monkeypatch.context() as m:
            m.setattr(heapq, "heappop", lambda _: pytest.fail("a state was settled by itself"))
            got = []
            assert routes.cheapest(cost, (0, 0), (11, 15), 1, momentum, settled=got) == want
        assert got == order


def test_searches_tell_new_places(spark):
    rng = np.random.default_rng(5)
    cost = rng.uniform(1, 100, (9, 8))
    maps = spark.createDataFrame([(7, r, c, float(v)) for (r, c), v in np.ndenumerate(cost)], "run_id long, row int, col int, v double")
    seen = routes.searches(maps, 9, 8, (0, 0), (8, 7), momentum=2)
    first = {(r.row, r.col): r.first for r in routes.first_visits(seen).collect()}
    assert {(r.row, r.col): r.step for r in seen.where("new").collect()} == first


def exchanges(df) -> int:
    """Shuffles in the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|single)", re.sub(r"ReusedExchange", "", final)))


def test_cells_of_a_line_stay_with_it(spark):
    rng = np.random.default_rng(6)
    rows = [(i, k, *map(float, rng.uniform(0, 50, 4))) for i in range(5) for k in range(30)]
    s = spark.createDataFrame(rows, "id long, seq int, ax double, ay double, bx double, by double")
    whole = crossings.cells_along(s.repartition(4, "id"), 10.0)
    assert exchanges(whole) == 1
    cells = {(r.id, r.row, r.col) for r in whole.collect()}
    assert cells == {tuple(r) for r in crossings.touched(s, 10.0).collect()}


def sparse(spark, rng, n=9, m=11, tiles=3, share=0.5):
    a = np.where(rng.random((tiles, n, m)) < share, rng.uniform(1, 100, (tiles, n, m)), np.nan)
    rows = [(k, 0, r, c, float(v)) for (k, r, c), v in np.ndenumerate(a) if v == v]
    return a, spark.createDataFrame(rows, "cell int, cdi long, row int, col int, v double")


def test_windows_of_several_sizes_send_pixels_once(spark):
    a, p = sparse(spark, np.random.default_rng(7))
    got = focal.local_stds(p.repartition(4, "cell"), (3, 4), 9, 11)
    assert exchanges(got) == 1 and len(got.collect()) == np.isfinite(a).sum()
    for r in got.collect():
        for size in (3, 4):
            low, high = focal.frame(size)
            mirror = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
            b = a[r.cell]
            # a column's values count where the row of the pixel has one in it
            cols = [mirror(c, 11) for c in range(r.col + low, r.col + high + 1)]
            v = [b[mirror(i, 9), c] for c in cols if np.isfinite(b[r.row, c]) for i in range(r.row + low, r.row + high + 1)]
            assert abs(r[f"s{size}"] - np.nanstd(v)) < 1e-6


def test_closings_in_one_pass(spark):
    mask = (np.random.default_rng(8).random((2, 12, 10)) < 0.1).astype(int)
    m = spark.createDataFrame([(k, 0, r, c, int(v)) for (k, r, c), v in np.ndenumerate(mask)], "cell int, cdi long, row int, col int, v int")
    got = {(r.cell, r.times): (r.dilated, r.after) for r in labels.closings(m, (1, 2), 12, 10).collect()}
    for k, times in got:
        pad = lambda x, v: np.lib.stride_tricks.sliding_window_view(np.pad(x, times, constant_values=v), (2 * times + 1,) * 2)
        wide = pad(mask[k], 0).max(axis=(2, 3))
        edge = np.ones_like(wide)
        edge[times:-times, times:-times] = wide[times:-times, times:-times]
        assert got[k, times] == (wide.sum(), pad(edge, 1).min(axis=(2, 3)).sum())
    assert "Window" not in labels.closed(m, 2, 12, 10)._jdf.queryExecution().executedPlan().toString() and len(got) == 4


def test_gradients_send_pixels_once(spark):
    a, p = sparse(spark, np.random.default_rng(9), share=0.8)
    moved = p.withColumn("row", F.col("row") + 4).withColumn("col", F.col("col") - 2)
    got = focal.sobel_magnitude(moved.repartition(4, "cell"))
    assert exchanges(got) == 1
    want = {}
    for k in range(3):
        for r in range(1, 8):
            for c in range(1, 10):
                x, y = (sum(w * a[k, r + i, c + j] for (i, j), w in s.items()) for s in (focal.SOBEL, {(j, i): w for (i, j), w in focal.SOBEL.items()}))
                if np.isfinite(np.hypot(x, y)):
                    want[k, r + 4, c - 2] = np.hypot(x, y)
    have = {(r.cell, r.row, r.col): r.v for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_enlarged_tiles_are_not_shuffled(spark):
    a, p = sparse(spark, np.random.default_rng(10), 6, 5)
    z = raster.zoomed(p, 3, 6, 5)
    written = z.count()
    assert written > 3 * 6 * 5 and exchanges(z) == 1  # of the pixels
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning")  # enlarged above the shuffle, not below it


def test_few_points_of_hulls_are_shuffled(spark):
    pts = np.random.default_rng(11).normal(size=(4000, 2)).round(2)
    df = spark.createDataFrame([(i % 3 if i % 7 else None, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double").coalesce(1)
    few = vector._hulls_of_batches(df, "id")
    assert few.count() < 200
    of = lambda d: {(r.id, r.x, r.y) for r in vector.hull(d, "id", 50).collect()}
    assert of(df) == of(df.repartition(7)) and {r[0] for r in of(df)} == {0, 1, 2, None}


def test_pixels_of_a_cell_stay_together(spark, sf):
    p = tables.pixels(spark, sf)
    assert exchanges(raster.dense(raster.combine(p, "mean"), 50, 50, ("cell",))) == 1
    assert exchanges(raster.to_tiles(p, 50, 50)) == 1
    assert exchanges(raster.shift_search(tables.soundings(spark, sf), 20.0, 50, 50)) == 1


def test_tasks_take_so_many_steps_of_routes(spark, sf, monkeypatch):
    monkeypatch.setattr(map_queries, "STEPS", 100)
    s = map_queries._segments(spark, sf)
    assert s.rdd.getNumPartitions() >= tables.read(spark, sf, "events").count() // 100 > 4
