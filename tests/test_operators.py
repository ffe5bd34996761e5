"""Operators on hand-made rasters, maps and files."""

import heapq
import itertools
import math
import struct

import numpy as np
import pytest

from tidegrid.functions import coords
from tidegrid.operators import costmap, focal, kernels, labels, raster, routes, vector
from tidegrid.schema import without_nans
from tidegrid.sources import readers
from tidegrid.streaming import arrivals


def pixels(spark, a, cell=0, cdi=0):
    rows = [(cell, cdi, r, c, None if not np.isfinite(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(a, float))]
    return spark.createDataFrame(rows, "cell int, cdi long, row int, col int, v double")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r.v is not None:
            out[r.row, r.col] = r.v
    return out


def test_nans_become_nulls(spark):
    df = without_nans(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double"))
    assert [r.v for r in df.collect()] == [None, 1.0, None]


def test_round_trip_of_coordinates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(51 + i / 7, j * 0.9) for i in range(35) for j in range(10)], "lat double, lon double")
    e, n = coords.utm_forward(F.col("lat"), F.col("lon"))
    lat, lon = coords.utm_inverse(F.col("e"), F.col("n"))
    back = df.select("lat", "lon", e.alias("e"), n.alias("n")).select("lat", "lon", lat.alias("a"), lon.alias("b"))
    assert max(max(abs(r.lat - r.a), abs(r.lon - r.b)) for r in back.collect()) < 1e-8
    # a place whose UTM position is published: Greenwich meridian at the equator and zone 31's own meridian
    e, n = coords.utm_forward(F.lit(0.0), F.lit(3.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert (r.e, r.n) == pytest.approx((500000.0, 0.0), abs=1e-6)


def test_grid_constants(spark):
    from pyspark.sql import functions as F

    row, col = coords.grid_index(F.col("x"), F.col("y"))
    df = spark.createDataFrame([(560123.0, 5931050.0), (629112.0, 5942337.0), (0.0, 0.0)], "x double, y double")
    assert [tuple(r) for r in df.select(row, col).collect()] == [(205, 44), (318, 734), (None, None)]
    r0, c0 = coords.cell_window(F.col("id").cast("int"))
    assert [tuple(r) for r in spark.createDataFrame([(0,), (15,), (111,)], "id int").select(r0, c0).collect()] == [(0, 0), (0, 750), (300, 750)]
    m = spark.createDataFrame([(1,), (2,), (4,), (8,)], "m int").select(coords.bend_radius(F.col("m"))).collect()
    assert [round(r[0], 1) for r in m] == [149.3, 298.5, 597.1, 1194.2]
    bad = spark.createDataFrame([("ED50", 1.0, 1.0)], "d string, n double, e double")
    with pytest.raises(Exception, match="unknown datum"):
        bad.select(coords.to_degrees(F.col("d"), F.col("n"), F.col("e"))[0]).collect()


def test_layers(spark):
    a = pixels(spark, [[1, np.nan], [np.nan, 2]]).select("row", "col", "v")
    b = pixels(spark, [[1, np.nan], [5, np.nan]]).select("row", "col", "v")
    assert np.array_equal(grid(costmap.layer_sum(a, b), (2, 2)), [[2, np.nan], [5, 2]], equal_nan=True)
    assert np.array_equal(grid(costmap.with_nulls_of(b, a), (2, 2)), [[1, np.nan], [np.nan, np.nan]], equal_nan=True)
    assert grid(costmap.filled_high(a), (2, 2)).tolist() == [[1, 2], [2, 2]]
    with pytest.raises(IndexError):
        costmap.window(-1, 0)
    n = costmap.noisy(pixels(spark, np.full((60, 60), 3.0)).select("row", "col", "v"), 0.5, 1)
    v = grid(n, (60, 60))
    assert v.mean() == pytest.approx(3, abs=0.05) and v.std() == pytest.approx(0.5, abs=0.05)


def test_whole_blocks_only(spark):
    a = np.arange(25.0).reshape(5, 5)
    assert grid(raster.block_reduce(pixels(spark, a), 5, "whole_max"), (1, 1)).tolist() == [[24]]
    a[2, 2] = np.nan
    assert np.isnan(grid(raster.block_reduce(pixels(spark, a), 5, "whole_max"), (1, 1))).all()
    b = np.full((4, 4), 3.0)
    b[0, 0] = -1
    assert grid(raster.block_reduce(pixels(spark, b), 4, "max"), (1, 1)).tolist() == [[3]]


def test_smooth_filled_until_nothing_is_missing(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=(30, 40)) + 50
    a[5:25, 3:37] = np.nan  # beyond the reach of one pass
    got = grid(focal.smooth_filled(pixels(spark, a), 1.0, 30, 40), a.shape)
    ok, want = np.isfinite(a), a.copy()
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    kernel, passes = np.outer(w, w) / w.sum() ** 2, 0
    while not np.isfinite(want).all():
        wide, before, passes = np.pad(want, 4, mode="edge"), want.copy(), passes + 1
        for r, c in np.argwhere(~np.isfinite(before)):
            box = wide[r : r + 9, c : c + 9]
            some = np.isfinite(box)
            if some.any():
                want[r, c] = (box[some] * kernel[some]).sum() / kernel[some].sum()
    assert passes > 1 and np.allclose(got, want, atol=1e-9) and np.array_equal(got[ok], a[ok])
    empty = focal.smooth_filled(pixels(spark, np.full((3, 4), np.nan)), 1.0, 3, 4)
    assert empty.count() == 12 and empty.where("v IS NOT NULL").count() == 0


def test_prominence_of_stripes(spark):
    rng = np.random.default_rng(12)
    y, x = np.mgrid[:60, :60]
    noise = rng.normal(size=(60, 60))
    tiles = raster.to_tiles(pixels(spark, noise + 4 * np.sin(x * 2.2)).unionByName(pixels(spark, noise, 1)), 60, 60)
    angles = spark.createDataFrame([(c, 0, a) for c in (0, 1) for a in (0, 90)], "cell int, cdi long, angle int")
    got = {}
    for a in (0, 90):
        for r in kernels.prominence(tiles, angles.where(f"angle = {a}")).collect():
            got[r.cell, a] = r.v
    along = max(got[0, 0], got[0, 90])  # the stripes' own direction stands out, in noise neither does
    others = [min(got[0, 0], got[0, 90]), got[1, 0], got[1, 90]]
    assert along > max(others) + 0.05, got


def test_positions_must_be_valid(spark):
    nan = float("nan")
    df = spark.createDataFrame([(52.0, 4.0), (52.3, 4.0), (52.3, 4.01), (nan, 4.0), (52.0, None)], "lat double, lon double")
    assert {(r.row, r.col): r.n for r in raster.position_grid(df, 0.25).collect()} == {(0, 0): 1, (1, 0): 2}
    for points, size in ((df, 0.0), (df.where("lon IS NULL"), 0.25)):
        with pytest.raises(ValueError):
            raster.position_grid(points, size)


def test_gaussian_is_the_kernel(spark):
    a = np.random.default_rng(0).normal(size=(14, 11))
    got = grid(focal.gaussian(pixels(spark, a), 1.3, 14, 11), a.shape)
    assert np.abs(got - kernels.smooth(a, 1.3)).max() < 1e-9


def test_nearest_by_hand():
    ok = np.random.default_rng(1).random((17, 9)) < 0.1
    d, at = kernels.nearest(ok)
    points = np.argwhere(ok)
    for (r, c), v in np.ndenumerate(d):
        assert v == pytest.approx(np.sqrt(((points - [r, c]) ** 2).sum(1).min()))
        assert ok.ravel()[at[r, c]]


def test_fill_and_surface():
    y, x = np.mgrid[0:20, 0:24]
    a = 3 + 0.2 * x - 0.1 * y + 0.01 * x * x + 0.02 * x * y
    hole = a.copy()
    hole[5:12, 6:14] = np.nan
    assert np.abs(kernels.surface(hole, 2) - a).max() < 1e-9
    f = kernels.filled(hole, reach=0.001)
    assert np.abs(f - a).max() < 1e-9 and not kernels.filled(np.full((3, 3), np.nan)).any()


def test_stripes(spark):
    y, x = np.mgrid[0:64, 0:64]
    a = 0.001 * (x - 30) ** 2 + np.sin(2 * np.pi * (x * np.cos(0.5) + y * np.sin(0.5)) / 5)
    t = raster.to_tiles(pixels(spark, a), 64, 64)
    angles = kernels.stripe_angles(t, width=0.7, centre=8.0)
    assert abs(angles.first().angle - math.degrees(0.5)) <= 4
    out = grid(raster.to_pixels(kernels.destripe(t, angles=angles)), (64, 64))
    inner = (slice(12, -12),) * 2
    assert (out - 0.001 * (x - 30) ** 2)[inner].std() < 0.5 * (a - 0.001 * (x - 30) ** 2)[inner].std()


def test_regions_and_small_ones(spark):
    a = np.random.default_rng(3).random((30, 30)) < 0.5
    todo, want = set(map(tuple, np.argwhere(a))), {}
    while todo:
        own, edge = set(), [min(todo)]
        while edge:
            p = edge.pop()
            if p in todo:
                todo.remove(p)
                own.add(p)
                edge += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        want[min(own)] = own
    cells = pixels(spark, np.where(a, 1.0, np.nan)).where("v = 1")
    got = {}
    for r in labels.regions(cells).collect():
        got.setdefault(r.region, set()).add((r.row, r.col))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    big = labels.without_small(cells, 9).count()
    assert big == sum(len(v) for v in want.values() if len(v) >= 9)


def test_bounded_clusters_by_enumeration(spark):
    x = [0.0, 0.1, 0.2, 0.3, 0.35, 0.4, 0.45, 9.0]
    df = spark.createDataFrame(list(enumerate(x)), "i int, f double")
    got = {r.i: r.label for r in labels.two_means(df, ["f"], ["i"], least=0.25, tolerance=1e-9).collect()}
    best = min(
        (sum((x[i] - np.mean([x[j] for j in s])) ** 2 for i in s) + sum((x[i] - np.mean([x[j] for j in set(range(8)) - set(s)])) ** 2 for i in set(range(8)) - set(s)), s)
        for k in range(2, 7) for s in itertools.combinations(range(8), k)
    )[1]
    assert sum(got.values()) >= 2 and {i for i, v in got.items() if v} in (set(best), set(range(8)) - set(best))


@pytest.mark.parametrize("momentum,turn", [(1, 1), (2, 1), (3, 2), (5, 1)])
def test_routes_are_cheapest(momentum, turn):
    rng = np.random.default_rng(momentum)
    cost = rng.random((9, 12)) + 0.2
    cost[rng.random(cost.shape) < 0.1] = np.inf
    cost[0, 0] = cost[8, 11] = 1
    got = routes.cheapest(cost, (0, 0), (8, 11), turn, momentum)
    heap, done = [(0.0, (0, 0, h, 0, h)) for h in range(8)], set()  # Dijkstra over all states, nothing left out
    want = None
    while heap:
        g, s = heapq.heappop(heap)
        if s in done:
            continue
        done.add(s)
        r, c, h, w, b = s
        if (r, c) == (8, 11):
            want = g
            break
        for new in range(8):
            d = abs(new - h) % 8
            if min(d, 8 - d) > turn or not (new == h or w == 0 or new == b):
                continue
            rr, cc = r + routes.STEPS[new][0], c + routes.STEPS[new][1]
            if 0 <= rr < 9 and 0 <= cc < 12 and np.isfinite(cost[rr, cc]):
                to = (rr, cc, new, max(0, w - 1), b) if new == h else (rr, cc, new, momentum - 1, h)
                heapq.heappush(heap, (g + math.hypot(*routes.STEPS[new]) * cost[rr, cc], to))
    assert (got[-1][3] if got else None) == (pytest.approx(want) if want is not None else None)


def test_route_per_map(spark):
    a = np.ones((8, 8))
    a[3, :7] = 0
    maps = pixels(spark, a).selectExpr("row", "col", "v", "explode(array(0L, 1L)) AS run_id")
    p = routes.routes(maps, 8, 8, (0, 0), (7, 0), turn=2)
    assert {(r.row, r.col) for r in p.where("run_id = 1").collect()} >= {(0, 0), (3, 7), (7, 0)}
    assert routes.frequency(p).agg({"n": "max"}).first()[0] == 2


def test_hull_by_hand(spark):
    pts = np.random.default_rng(4).normal(size=(3000, 2)).round(3)
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in pts], "id int, x double, y double")
    got = {(r.x, r.y) for r in vector.hull(df, "id", 100).collect()}
    p = sorted(set(map(tuple, pts.tolist())))
    side = lambda q: [q[0]] if len(q) == 1 else None
    def chain(q):
        out = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out

    assert side(p) is None and got == set(chain(p)) | set(chain(p[::-1]))


def test_files(spark, tmp_path):
    (tmp_path / "aoi.txt").write_text("631046,6308 5945849,0992\n634784,7374\t5922648,2295\n559385,3227 5910511,5977\n555651,6378 5933695,5132\n631046,6308 5945849,0992\n")
    a = readers.area(spark, str(tmp_path / "aoi.txt")).orderBy("seq").collect()
    assert len(a) == 5 and a[0].x == 631046.6308
    ring = readers.area(spark, str(tmp_path / "aoi.txt")).where("seq < 4").selectExpr("1 AS id", "seq", "x", "y")
    assert vector.areas(ring).first().area == pytest.approx(1794014413.35, abs=0.01)
    tile = np.arange(6.0).reshape(2, 3)
    tile[0, 1] = np.nan
    np.save(tmp_path / "cell_7_CDI_42.npy", tile)
    t = readers.npy_tiles(spark, str(tmp_path / "*.npy")).first()
    assert (t.cell, t.cdi, t.h, t.w, t["data"]) == (7, 42, 2, 3, [0.0, None, 2.0, 3.0, 4.0, 5.0])
    xy = struct.pack("<4d", 1, 2, 3, 4)
    body = struct.pack("<i4d", 3, 1, 2, 3, 4) + struct.pack("<iii", 1, 2, 0) + xy
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    assert [(r.id, r.x, r.y) for r in readers.shapes(spark, str(tmp_path / "*.shp")).collect()] == [(1, 1.0, 2.0), (1, 3.0, 4.0)]
    (tmp_path / "xyz").mkdir()
    (tmp_path / "xyz/000574_XYZ_a_V1.txt").write_text("Lat (DMS)\tLong (DMS)\tMean (m)\n52-30-15.5N\t3-0-0.0E\t-20.5\n")
    s = readers.soundings(spark, str(tmp_path / "xyz"), True).first()
    assert (s.lat, s.e, s.depth) == (pytest.approx(52.504305555), pytest.approx(500000, abs=1e-3), -20.5)
    assert readers.headers(spark, str(tmp_path / "xyz")).first().fields == ["Lat (DMS)", "Long (DMS)", "Mean (m)"]
    names = [c.split("`")[1] if "`" in c else c.split()[0] for c in readers.METADATA.split(", ")]
    (tmp_path / "m.csv").write_text(",".join(names) + "\n9,a/v1,x,UTM 31N (32631),1,2,3,4,20040131,20040201,0,25.5\n")
    m = readers.metadata(spark, str(tmp_path / "m.csv")).first()
    assert (m.cdi, m.year, m.density, str(m.end_date)) == (9, 2004, 25.5, "2004-02-01")


def test_surveys_arrive(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 50), float(i % 30), float(i)) for i in range(200)], "e double, n double, depth double")
    df.where("depth < 100").write.parquet(str(tmp_path / "in/a"))
    df.where("depth >= 100").write.mode("append").parquet(str(tmp_path / "in/b"))
    counts = arrivals.pixel_counts(arrivals.arriving(spark, str(tmp_path / "in/*"), "e double, n double, depth double", 1), 10.0)
    q = arrivals.kept_up(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    got = {(r.row, r.col): r.n for r in spark.read.parquet(str(tmp_path / f"out/batch={last}")).collect()}
    assert got == {(r.row, r.col): r.n for r in arrivals.pixel_counts(df, 10.0).collect()} and last > 0


def test_cleaned_fills_holes_before_sizes(spark):
    ring = lambda r, c: max(abs(r - 10), abs(c - 10)) <= 6 and max(abs(r - 10), abs(c - 10)) > 3
    bay = lambda r, c: c < 3 and r in (2, 6) or c == 3 and 2 <= r <= 6  # noqa: E731  a bay at the tile's edge stays open
    df = spark.createDataFrame([(k, r, c, int((ring if k == 0 else bay)(r, c))) for k in (0, 1) for r in range(21) for c in range(21)], "cell int, row int, col int, v int")
    full = labels.filled_holes(df, 21, 21, ("cell",)).where("v = 1").groupBy("cell").count().collect()
    assert {r["cell"]: r["count"] for r in full} == {0: 169, 1: 11}
    got = labels.cleaned(df.where("cell = 0"), 21, 21, 0.3, 0.5, 1, 160, ("cell",)).where("v = 1").count()
    assert got == 169  # 120 pixels without the hole


def test_regions_and_limited_gaps_by_flood_fill():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 9), (13, 11), (30, 30)):
        mask = rng.random(shape) < 0.55
        want = np.arange(mask.size).reshape(shape)
        seen = np.zeros(shape, bool)
        for r, c in zip(*np.nonzero(mask)):
            todo, first = [(r, c)], want[r, c]
            while todo:
                y, x = todo.pop()
                if 0 <= y < shape[0] and 0 <= x < shape[1] and mask[y, x] and not seen[y, x]:
                    seen[y, x], want[y, x] = True, first
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert (kernels.components4(mask) == want).all()
        a = np.where(mask, np.nan, rng.random(shape))
        size = np.bincount(want[mask], minlength=mask.size)
        got = kernels.filled_gaps(a, 3)
        if not mask.all():
            assert (np.isnan(got) == (mask & (size[want] > 3))).all()
            assert (got[~mask] == a[~mask]).all()
            for y, x in zip(*np.nonzero(mask & (size[want] <= 3))):
                d = (np.arange(shape[0])[:, None] - y) ** 2 + (np.arange(shape[1])[None] - x) ** 2
                assert got[y, x] in a[~mask & (d == d[~mask].min())]
