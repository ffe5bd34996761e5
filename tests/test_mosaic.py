"""The whole map against flood fills, brute force and SQL."""

import numpy as np
import pytest

from tidegrid.operators import mosaic, raster


def cells(spark, a, key=None):
    rows = [(r, c, None if not np.isfinite(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(a, float))]
    if key is not None:
        return spark.createDataFrame([(key, *r) for r in rows], "map int, row int, col int, v double")
    return spark.createDataFrame(rows, "row int, col int, v double")


def flood(mask):
    """The first pixel of each pixel's region, by a walk."""
    out = np.full(mask.shape, -1, np.int64)
    for start in np.argwhere(mask).tolist():
        if out[tuple(start)] >= 0:
            continue
        todo = [tuple(start)]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and out[r, c] < 0:
                out[r, c] = start[0] * mosaic.STRIDE + start[1]
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def spiral(n):
    a = np.zeros((n, n), bool)
    r, c, dr, dc = 0, 0, 0, 1
    a[0, 0] = True
    while True:
        for _ in range(2):
            y, x = r + dr, c + dc
            ahead = (y + dr, x + dc)
            free = 0 <= y < n and 0 <= x < n and not a[y, x] and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and a[ahead])
            if free:
                break
            dr, dc = dc, -dr
        if not free:
            return a
        r, c = r + dr, c + dc
        a[r, c] = True


@pytest.mark.parametrize("kind, side", [("noise", 8), ("dense", 7), ("spiral", 5), ("full", 10), ("none", 4), ("checks", 6)])
def test_regions_over_tiles(spark, kind, side):
    rng = np.random.default_rng(3)
    mask = {"noise": rng.random((41, 53)) < 0.55, "dense": rng.random((30, 30)) < 0.7, "spiral": spiral(31), "full": np.ones((25, 33), bool), "none": np.zeros((3, 3), bool), "checks": np.indices((20, 20)).sum(0) % 2 == 0}[kind]
    df = cells(spark, np.where(mask, 1.0, np.nan)).where("v IS NOT NULL")
    got = np.full(mask.shape, -1, np.int64)
    for r in mosaic.regions(df, side).collect():
        got[r.row, r.col] = r.region
    assert (got == flood(mask)).all()


def test_regions_of_several_maps(spark):
    masks = [np.random.default_rng(i).random((20, 25)) < 0.6 for i in range(3)]
    df = None
    for i, m in enumerate(masks):
        d = cells(spark, np.where(m, 1.0, np.nan), i).where("v IS NOT NULL")
        df = d if df is None else df.unionByName(d)
    got = [np.full((20, 25), -1, np.int64) for _ in masks]
    for r in mosaic.regions(df, 6, ("map",)).collect():
        got[r.map][r.row, r.col] = r.region
    assert all((g == flood(m)).all() for g, m in zip(got, masks))


def test_smallest_reached(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, 5000)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in mosaic.smallest_reached(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in list(parent)}
    assert mosaic.smallest_reached(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lower_envelope():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        rows = np.sort(rng.choice(60, n, replace=False))
        h = rng.integers(0, int(rng.choice([2, 30, 2000])), n) ** 2
        at = np.arange(60)
        cost = (at[:, None] - rows) ** 2 + h
        assert (mosaic.lower_envelope(rows, h, at) == cost.argmin(1)).all()


@pytest.mark.parametrize("share, shape", [(0.05, (37, 44)), (0.6, (20, 31)), (0.001, (25, 25)), (1.0, (5, 6))])
def test_nearest_values(spark, share, shape):
    rng = np.random.default_rng(6)
    a = np.where(rng.random(shape) < share, rng.normal(size=shape), np.nan)
    a[3, 3] = -1  # a blocked pixel is a value
    at = np.argwhere(np.isfinite(a))
    for r in mosaic.nearest_values(cells(spark, a)).collect():
        d2 = ((at - [r.row, r.col]) ** 2).sum(1)
        best = at[d2.argmin()]  # argwhere's order: by row, then column
        assert (r.d2, r.near_row, r.near_col, r.near) == (d2.min(), *best.tolist(), a[tuple(best)])


def test_nothing_to_fill_from(spark):
    got = mosaic.filled(cells(spark, np.full((4, 5), np.nan))).collect()
    assert len(got) == 20 and all(r.v is None for r in got)
    assert mosaic.filled(cells(spark, np.zeros((0, 0))), 3).count() == 0


@pytest.mark.parametrize("most, side", [(None, 8), (4, 8), (9, 5), (0, 8)])
def test_filled(spark, most, side):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((33, 42)) < 0.62, np.round(rng.normal(size=(33, 42)), 3), np.nan)
    gaps = flood(~np.isfinite(a))
    size = {g: (gaps == g).sum() for g in np.unique(gaps[gaps >= 0])}
    at = np.argwhere(np.isfinite(a))
    want = a.copy()
    for r, c in np.argwhere(~np.isfinite(a)):
        if most is None or size[gaps[r, c]] <= most:
            want[r, c] = a[tuple(at[((at - [r, c]) ** 2).sum(1).argmin()])]
    got = np.full(a.shape, np.nan)
    for r in mosaic.filled(cells(spark, a), most, side).collect():
        got[r.row, r.col] = np.nan if r.v is None else r.v
    assert np.array_equal(got, want, equal_nan=True)


def test_dense_without_a_join(spark):
    """Tiles are made whole in place: a joined grid packs so well that Spark takes it for small and sends it through the driver."""
    rows = [(0, 0, 1, 2.5), (0, 2, 0, None), (1, 1, 1, None), (2, 5, 0, 1.0), (2, 0, -1, 1.0), (2, 1, 2, 3.0)]
    p = spark.createDataFrame(rows, "cell int, row int, col int, v double")
    got = raster.dense(p, 3, 3, ("cell",))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.cell, r.row, r.col): r.v for r in got.collect()}
    assert sorted(got) == [(c, y, x) for c in range(3) for y in range(3) for x in range(3)]
    assert {k: v for k, v in got.items() if v is not None} == {(0, 0, 1): 2.5, (2, 1, 2): 3.0}


def test_gaps_filled_without_copies(spark):
    """Only single gaps inside are filled, and no pixel is sent to its neighbours as a row of its own."""
    a = np.arange(20.0).reshape(4, 5)
    a[1, 1] = a[2, 3] = a[2, 4] = a[0, 3] = np.nan
    got = raster.gaps_filled(cells(spark, a, 0), ("map",))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = a.copy()
    want[1, 1] = (1 + 11 + 5 + 7) / 4
    found = np.full(a.shape, np.nan)
    for r in got.collect():
        found[r.row, r.col] = np.nan if r.v is None else r.v
    assert np.array_equal(found, want, equal_nan=True)
