"""The shift search against a loop over all shifts."""

import numpy as np
import pytest

from tidegrid.operators import change


def by_hand(a, b, most):
    """Every shift as slices, columns in the outer loop: n and mean by (dy, dx), and the first with the smallest mean."""
    h, w = a.shape
    found, best = {}, None
    for dx in range(-most, most + 1):
        for dy in range(-most, most + 1):
            x = a[max(0, dy) : max(0, min(h, h + dy)), max(0, dx) : max(0, min(w, w + dx))]
            y = b[max(0, -dy) : max(0, min(h, h - dy)), max(0, -dx) : max(0, min(w, w - dx))]
            d = (x - y)[np.isfinite(x - y)]
            if len(d):
                found[dy, dx] = len(d), d.mean()
                if best is None or round(d.mean(), 9) < round(found[best][1], 9):
                    best = dy, dx
    return found, best


def holes(rng, shape, share):
    return np.where(rng.random(shape) < share, rng.normal(size=shape) * 10 + 50, np.nan)


@pytest.mark.parametrize("shape, most, share", [((9, 13), 4, 0.6), ((6, 5), 8, 0.9), ((20, 17), 30, 0.2), ((1, 1), 3, 1.0), ((50, 50), 30, 0.47)])
def test_all_shifts(shape, most, share):
    rng = np.random.default_rng(most)
    a, b = holes(rng, shape, share), holes(rng, shape, share)
    want, best = by_hand(a, b, most)
    n, total = change.shift_sums(a, b, most)
    assert {(i - most, j - most): int(n[i, j]) for i, j in np.argwhere(n > 0).tolist()} == {k: v[0] for k, v in want.items()}
    assert all(abs(total[dy + most, dx + most] / v[0] - v[1]) < 1e-8 for (dy, dx), v in want.items())
    assert change.least_mean(a, b, most) == (*best, want[best][0], round(want[best][1], 9))


def test_ties_and_nothing():
    flat = np.full((4, 4), 3.0)
    assert change.least_mean(flat, flat, 2) == (-2, -2, 4, 0.0)
    apart = np.full((3, 3), np.nan)
    assert change.least_mean(apart, flat[:3, :3], 2) is None


def test_pairs_of_surveys(spark):
    rng = np.random.default_rng(1)
    tiles = {(cell, cdi): holes(rng, (8, 9), 0.7) for cell in range(2) for cdi in range(3)}
    tiles[1, 2][:] = np.nan
    rows = [(c, i, 2000 + i if i < 2 else 2001, 8, 9, [None if np.isnan(v) else float(v) for v in a.ravel()]) for (c, i), a in tiles.items()]
    df = spark.createDataFrame(rows, "cell int, cdi long, year int, h int, w int, data array<double>")
    pairs = change.tile_pairs(df)
    names = {(r.cell, r.id_old, r.id_new, r.dt) for r in pairs.collect()}
    assert names == {(c, 0, i, 1) for c in range(2) for i in (1, 2)}  # surveys of one year aren't a pair
    got = {(r.cell, r.id_new): (r.dy, r.dx, r.n, r["mean"]) for r in change.best_shifts(pairs, 5).collect()}
    for c, i in ((0, 1), (0, 2), (1, 1)):
        a, b = tiles[c, i], tiles[c, 0]
        found, best = by_hand(a - np.nanmean(a), b - np.nanmean(b), 5)
        assert got[c, i] == (*best, found[best][0], pytest.approx(found[best][1], abs=1e-9))
    assert set(got) == {(0, 1), (0, 2), (1, 1)}
    scores = {(r.dy, r.dx): (r.n, r["mean"]) for r in change.shift_scores(pairs.where("cell = 0 AND id_new = 1"), 5).collect()}
    want, _ = by_hand(tiles[0, 1], tiles[0, 0], 5)
    assert scores == {k: (n, pytest.approx(m, abs=1e-9)) for k, (n, m) in want.items()}
    assert change.best_shifts(pairs.limit(0), 5).count() == 0
