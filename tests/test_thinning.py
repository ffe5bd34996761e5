"""Thinning against a slow version, and what must hold of its result."""

import numpy as np
import pytest

from tidegrid.operators import labels, thinning
from tidegrid.plans import map_queries


def parts(mask, eight=True):
    """Connected parts, as sets of pixels."""
    left, out = set(map(tuple, np.argwhere(mask).tolist())), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if eight or not (a and b)} & left
            left -= near
            todo += near
        out.append(part)
    return out


def slow(mask):
    """The same rule, pixel by pixel: a pixel goes from a side if it has no neighbour there, two or more, and they are one part without it."""
    m = {tuple(p) for p in np.argwhere(mask).tolist()}
    while True:
        before = len(m)
        for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            gone = set()
            for r, c in m:
                near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b)} & m
                if (r + dr, c + dc) in m or len(near) < 2:
                    continue
                box = np.zeros((3, 3), bool)
                for y, x in near:
                    box[y - r + 1, x - c + 1] = True
                if len(parts(box)) == 1:
                    gone.add((r, c))
            m -= gone
        if len(m) == before:
            return m


def mask_of(spark, mask, key=0):
    return spark.createDataFrame([(key, int(r), int(c)) for r, c in np.argwhere(mask)], "run int, row int, col int")


def shapes():
    rng = np.random.default_rng(1)
    block, ring, line = np.ones((2, 2), bool), np.ones((11, 12), bool), np.zeros((30, 40), bool)
    ring[4:7, 4:8] = False
    for r, c in zip(np.linspace(2, 26, 200), np.linspace(2, 36, 200)):
        line[int(r) : int(r) + 3, int(c) : int(c) + 3] = True
    stairs = np.zeros((12, 12), bool)
    for i in range(11):
        stairs[i, i] = stairs[i, i + 1] = True
    return [block, ring, line, stairs, rng.random((20, 20)) < 0.6, np.ones((1, 9), bool), np.ones((7, 9), bool)]


@pytest.mark.parametrize("side, rounds", [(256, 8), (16, 1), (10, 2)])
def test_thinned_in_tiles(spark, side, rounds):
    """Masks of many tiles, some left of 0 and wider than the margin, come out as from one piece."""
    for m in [shapes()[1], shapes()[2], shapes()[4], np.ones((31, 42), bool)]:
        d = mask_of(spark, m).selectExpr("run", "row - 7 AS row", "col - 20 AS col")
        got = {(r.row + 7, r.col + 20) for r in thinning.thinned(d.union(d.limit(5)), ("run",), side, rounds).collect()}
        assert got == slow(m)


def test_small_masks_in_one_pass(spark, monkeypatch):
    """Masks within a tile are written once; before, once a round."""
    written = []
    monkeypatch.setattr(thinning, "saved", lambda df: written.append(1) or labels.saved(df))
    assert thinning.thinned(mask_of(spark, np.ones((20, 30), bool)), ("run",)).count()
    assert len(written) == 1


def test_thinned_masks(spark):
    every = None
    for i, m in enumerate(shapes()):
        d = mask_of(spark, m, i)
        every = d if every is None else every.unionByName(d)
    got = {}
    for r in thinning.thinned(every, ("run",)).collect():
        got.setdefault(r.run, set()).add((r.row, r.col))
    for i, m in enumerate(shapes()):
        assert got[i] == slow(m)
        thin = np.zeros(m.shape, bool)
        thin[tuple(zip(*got[i]))] = True
        assert [len(parts(m))] == [len(parts(thin))]  # nothing vanishes or falls apart
        holes = lambda x: len(parts(~np.pad(x, 1), eight=False))
        assert i == 4 or holes(m) == holes(thin)
        full = thin[:-1, :-1] & thin[1:, :-1] & thin[:-1, 1:] & thin[1:, 1:]
        assert i == 4 or not full.any()  # one pixel wide
    assert len(got[3]) < shapes()[3].sum()
    assert thinning.thinned(every.limit(0), ("run",)).count() == 0


def test_thin_routes(spark, sf):
    """The query's whole result, by the slow version."""
    masks = {}
    for r in map_queries._wide_masks(spark, sf).collect():
        masks.setdefault(r.run_id, np.zeros((60, 60), bool))[r.row + 2, r.col + 2] = True
    got = {r.run_id: (r.n, r.thin) for r in map_queries.thin_routes(spark, sf).collect()}
    some = sorted(masks)[:12]
    assert set(got) == set(masks)
    assert {i: got[i] for i in some} == {i: (int(masks[i].sum()), len(slow(masks[i]))) for i in some}
