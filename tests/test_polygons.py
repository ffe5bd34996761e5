"""Points in polygons against the plain ray rule."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import vector
from tidegrid.plans import map_queries


def ray(points, edges):
    """(id, place of the point) by every edge of every polygon."""
    out = set()
    for i in {e[0] for e in edges}:
        own = np.array([e[1:] for e in edges if e[0] == i])
        x1, y1, x2, y2 = own.T
        for n, (x, y) in enumerate(points):
            with np.errstate(all="ignore"):
                hit = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            if hit.sum() % 2:
                out.add((i, n))
    return out


def ring(i, xy):
    return [(i, *map(float, a), *map(float, b)) for a, b in zip(xy, np.roll(xy, -1, axis=0))]


def inside(spark, points, edges, size):
    p = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(points)], "n int, x double, y double")
    got = [(r.id, r.n) for r in vector.inside(p, spark.createDataFrame(edges, "id long, x1 double, y1 double, x2 double, y2 double"), size).select("id", "n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("size, together", [(7.0, 2000), (3.3, 2000), (100.0, 2000), (16.0, 3)])
def test_tangled_rings(spark, monkeypatch, size, together):
    """Rings that cross themselves, holes as second rings, flat edges, corners and points on lines of the grid and on edges."""
    monkeypatch.setattr(vector, "TOGETHER", together)
    rng = np.random.default_rng(2)
    edges = []
    for i in range(6):
        edges += ring(i, rng.integers(-20, 60, (int(rng.integers(3, 25)), 2)))
    edges += ring(7, [(0, 0), (49, 0), (49, 49), (0, 49)]) + ring(7, [(7, 7), (35, 7), (35, 35), (7, 35)])
    edges += ring(8, [(0, 0), (40, 0), (40, 14), (20, 14), (20, 28), (40, 28), (40, 42), (0, 42)])
    edges += ring(9, np.stack([20 + 25 * np.cos(np.linspace(0, 6.2, 90)), 20 + 25 * np.sin(np.linspace(0, 6.2, 90))], 1))
    grid = [(x, y) for x in range(-21, 63, 7) for y in range(-21, 63, 7)]
    points = grid + rng.integers(-22, 62, (300, 2)).tolist() + rng.uniform(-25, 65, (400, 2)).tolist() + [(0.5, 0.5)] * 3
    points += [((a[1] + a[3]) / 2, (a[2] + a[4]) / 2) for a in edges[:60]]
    assert inside(spark, points, edges, size) == ray(points, edges)


def test_points_without_a_place(spark):
    square = spark.createDataFrame(ring(1, [(0, 0), (9, 0), (9, 9), (0, 9)]), "id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (1.0, None), (20.0, 1.0)], "x double, y double")
    assert [tuple(r) for r in vector.inside(p, square, 2.0).collect()] == [(1, 1.0, 1.0)]
    assert vector.inside(p.limit(0), square, 2.0).count() == 0 and vector.inside(p, square.limit(0), 2.0).count() == 0


def test_work_is_local(spark):
    """A polygon of very many edges: a cell lists those that touch it, not those of its row."""
    t = np.linspace(0, 2 * np.pi, 20_001)[:-1]
    edges = spark.createDataFrame(ring(1, np.stack([500 + 400 * np.cos(t), 500 + 400 * np.sin(t)], 1)), "id long, x1 double, y1 double, x2 double, y2 double")
    full, cut = vector.grid_of(edges, 10.0)
    assert cut.agg(F.sum(F.size("e"))).first()[0] < 25_000 and cut.agg(F.max(F.size("e"))).first()[0] < 300
    assert abs(full.count() + cut.count() / 2 - np.pi * 40 * 40) < 120


def test_places_tested_once(spark, sf, tmp_path, monkeypatch):
    """Twice the soundings at the same places: twice the counts, but no more points to test; and smaller cells for more points."""
    soundings = spark.read.parquet(f"{sf}/lineitem.parquet")
    suppliers = spark.range(20).selectExpr("id * 111 AS s_suppkey", "CAST(id % 2 AS INT) AS s_nationkey")
    for i, given in enumerate((soundings, soundings.unionAll(soundings))):
        given.write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        suppliers.write.parquet(f"{tmp_path}/{i}/supplier.parquet")
    tested, inside = [], vector.inside
    monkeypatch.setattr(vector, "inside", lambda p, *a: tested.append(p.count()) or inside(p, *a))
    one, two = ({r.id: r.n for r in map_queries.points_in_polygons(spark, d).collect()} for d in (f"{tmp_path}/0", f"{tmp_path}/1"))
    assert one and two == {k: 2 * n for k, n in one.items()}
    assert tested[0] == tested[1]
    assert map_queries._cell_size(600_000) == 10 and map_queries._cell_size(25_000_000) == 1.25


def test_large_tables_of_cells_are_not_broadcast(spark, monkeypatch):
    """Few edges, spread over many cells: Spark takes the cells to be as few as the edges, so that it must be told; cells inside count too."""
    monkeypatch.setattr(vector, "FEW", 1000)
    diamond = ring(1, [(0, 50), (50, 0), (100, 50), (50, 100)])
    points = [(x, y) for x in range(-5, 110, 5) for y in range(-5, 110, 5)]
    p = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(points)], "n int, x double, y double")
    e = spark.createDataFrame(diamond, "id long, x1 double, y1 double, x2 double, y2 double")
    full, cut = vector.grid_of(e, 1.0)
    assert cut.agg(F.sum(F.size("e"))).first()[0] < 1000 < full.count()
    for size, large in ((1.0, True), (10.0, False)):
        found = vector.inside(p, e, size)
        assert {(r.id, r.n) for r in found.select("id", "n").collect()} == ray(points, diamond)
        assert ("Broadcast" in found._jdf.queryExecution().executedPlan().toString()) != large


def test_rows_of_a_polygon_go_to_several_tasks(spark, monkeypatch):
    """One polygon: its cells are found row by row in all tasks, without a join, and its edges are dealt to them before they are spread."""
    plans = []
    monkeypatch.setattr(vector, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    e = spark.createDataFrame([(1, n, *map(float, xy)) for n, xy in enumerate(np.random.default_rng(3).integers(0, 99, (50, 2)))], "id long, seq int, x double, y double")
    vector.grid_of(vector.edges(e), 10.0)
    assert "Join" not in plans[0]
    assert re.search(r"hashpartitioning\(id#\d+L?, r#", plans[0]) and plans[0].index("hashpartitioning(id") < plans[0].index("hashpartitioning(x1")
