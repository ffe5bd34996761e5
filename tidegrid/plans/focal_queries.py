"""Queries over neighbourhoods, labels and spectra of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import focal, kernels, labels, raster

from . import tables
from .tables import COLS, ROWS

P = tables.text(f"({tables.PIXELS})")
TILE = ("cell", "cdi")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(spark, sf_dir).select("cell", "cdi", "row", "col", "v")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dense(_pixels(spark, sf_dir), ROWS, COLS)


def _by_row(df: DataFrame, *more: str) -> DataFrame:
    """A digest of a raster: number, mean and weighted sum of each tile's values."""
    return df.where("v IS NOT NULL").groupBy(*TILE, *more).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 7).alias("mean"), F.round(F.sum(F.col("v") * (F.col("row") * COLS + F.col("col"))) / ROWS / COLS, 5).alias("moment"))


def local_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviation in windows of ten pixels, off centre, mirrored at the edges."""
    return _by_row(focal.local_std(_pixels(spark, sf_dir), 10, ROWS, COLS))


def local_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_row(focal.local_variance(_pixels(spark, sf_dir), 5, ROWS, COLS))


def local_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range in windows of 15 pixels."""
    p = _dense(spark, sf_dir)
    lo, hi = focal.extreme(p, 15, "min", ROWS, COLS), focal.extreme(p, 15, "max", ROWS, COLS).withColumnRenamed("v", "hi")
    return _by_row(lo.join(hi, [*TILE, "row", "col"]).withColumn("v", F.col("hi") - F.col("v")))


def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the mean raster by Sobel's weights."""
    p = raster.combine(tables.pixels(spark, sf_dir), "mean").withColumn("cdi", F.lit(0).cast("long"))
    return _by_row(focal.sobel_magnitude(p))


def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the mean raster by central differences."""
    p = raster.combine(tables.pixels(spark, sf_dir), "mean").withColumn("cdi", F.lit(0).cast("long"))
    return _by_row(focal.gradient_magnitude(raster.dense(p, ROWS, COLS), ROWS, COLS))


def gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian mean of the values there are."""
    return _by_row(focal.gaussian(_dense(spark, sf_dir), 1.5, ROWS, COLS))


def smooth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing pixels filled once from what lies within reach of a Gaussian."""
    return _by_row(focal.smooth_filled(_dense(spark, sf_dir), 1.5, ROWS, COLS, most=1))


def relative_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of 180 angles above that of the angles around, and the angle where it is largest."""
    e = tables.soundings(spark, sf_dir).groupBy("cdi", (F.floor(F.col("e")) % 180).cast("int").alias("angle")).agg(F.avg("depth").alias("v"))
    h = focal.relative_height(e, 180, ("cdi",))
    best = h.groupBy("cdi").agg(F.max(F.struct(F.round("height", 9).alias("height"), (-F.col("angle")).alias("a"))).alias("b"))
    return best.select("cdi", (-F.col("b.a")).alias("angle"), "b.height")


def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the connected regions of deep pixels, by tile."""
    r = labels.regions(_pixels(spark, sf_dir).where("v > 50"))
    return r.groupBy(*TILE, "region").agg(F.count(F.lit(1)).alias("n")).groupBy(*TILE).agg(F.count(F.lit(1)).alias("regions"), F.max("n").alias("largest"), F.sum(F.col("n") * F.col("n")).alias("squares"))


def closed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep pixels closed twice with a square: pixels before and after."""
    m = _dense(spark, sf_dir).withColumn("v", F.coalesce((F.col("v") > 70).cast("int"), F.lit(0)))
    c = labels.closed(m, 2, ROWS, COLS).groupBy(*TILE).agg(F.sum("v").alias("after"))
    return m.groupBy(*TILE).agg(F.sum("v").alias("before")).join(c, list(TILE))


def cleaned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each cell's mean raster smoothed, closed and without small regions: pixels of each label."""
    p = raster.combine(tables.pixels(spark, sf_dir), "mean")
    l = raster.dense(p, ROWS, COLS, ("cell",)).withColumn("v", (F.col("v") > 55).cast("double"))
    return labels.cleaned(l, ROWS, COLS, 1.5, 0.5, 1, 30, ("cell",)).groupBy("cell", "v").agg(F.count(F.lit(1)).alias("n"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.to_tiles(_pixels(spark, sf_dir), ROWS, COLS)


def filled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes filled from the nearest pixel and a quadratic surface, smoothed."""
    return _by_row(raster.to_pixels(kernels.on_tiles(_tiles(spark, sf_dir), lambda a: kernels.filled(a, 2, 15.0, 2.0))))


def stripe_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.stripe_angles(_tiles(spark, sf_dir)).withColumn("height", F.round("height", 6))


def destriped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles less their stripes, against what they were."""
    t = _tiles(spark, sf_dir)
    after = raster.to_pixels(kernels.destripe(t)).select(*TILE, "row", "col", F.col("v").alias("w"))
    both = _pixels(spark, sf_dir).join(after, [*TILE, "row", "col"])
    return both.groupBy(*TILE).agg(F.count("w").alias("n"), F.round(F.stddev_pop("v"), 6).alias("before"), F.round(F.stddev_pop("w"), 6).alias("after"), F.round(F.avg(F.col("v") - F.col("w")), 6).alias("moved"))


def fill_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roughness of filled tiles under several degrees and reaches, each a row of a parameter table."""
    grid = spark.createDataFrame([(d, r) for d in (1, 2, 3) for r in (5.0, 15.0, 30.0)], "degree int, reach double")
    t = _tiles(spark, sf_dir).crossJoin(F.broadcast(grid))  # nine rows
    keys = (*TILE, "degree", "reach")
    found = kernels.on_tiles(t, lambda a, d, r: kernels.filled(a, d, r), keys, ("degree", "reach"))
    return raster.to_pixels(found, keys).groupBy("degree", "reach").agg(F.round(F.stddev_pop("v"), 6).alias("sd"), F.count("v").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        local_spread, local_variance, local_extremes, sobel, gradient, gaussian, smooth_fill, relative_response, label_regions, closed_labels,
        cleaned_labels, filled_tiles, stripe_angles, destriped, fill_parameters,
    )
}

_GRID = f"(SELECT cell, cdi, r AS row, c AS col FROM (SELECT DISTINCT cell, cdi FROM {P}), (SELECT unnest(range(50)) AS r), (SELECT unnest(range(50)) AS c))"
_DENSE = f"(SELECT g.cell, g.cdi, g.row, g.col, p.v FROM {_GRID} g LEFT JOIN {P} p ON g.cell = p.cell AND g.cdi = p.cdi AND g.row = p.row AND g.col = p.col)"
_MEAN = f"(SELECT cell, CAST(0 AS BIGINT) AS cdi, row, col, avg(v) AS v FROM {P} GROUP BY ALL)"


def _digest(q: str) -> str:
    return f"SELECT cell, cdi, count(*) AS n, round(avg(v), 7) AS mean, round(sum(v * (row * 50 + col)) / 50 / 50, 5) AS moment FROM ({q}) WHERE v IS NOT NULL GROUP BY ALL"


def _mirror(q: str, a: int, edge: bool = False) -> str:
    """All pixels, and those mirrored beyond the edges by up to `a`, or the edge's own."""
    ext = lambda axis: f"(SELECT unnest(range(-{a}, {50 + a})) AS {axis}_to)"
    fold = lambda x: f"CASE WHEN {x} < 0 THEN {0 if edge else f'-1 - {x}'} WHEN {x} > 49 THEN {49 if edge else f'99 - {x}'} ELSE {x} END"
    return f"(SELECT cell, cdi, row_to AS row, col_to AS col, v FROM {q} p JOIN {ext('row')} r ON p.row = {fold('row_to')} JOIN {ext('col')} c ON p.col = {fold('col_to')})"


def _window(size: int, value: str) -> str:
    before, after = size // 2, size - size // 2 - 1
    rows = f"(SELECT cell, cdi, row, col, sum(v) OVER w AS s, sum(v * v) OVER w AS q, count(v) OVER w AS k FROM {_mirror(P, size // 2)} WINDOW w AS (PARTITION BY cell, cdi, col ORDER BY row RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING))"
    return f"""WITH b AS (SELECT cell, cdi, row, col, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(k) OVER w AS k FROM {rows} WINDOW w AS (PARTITION BY cell, cdi, row ORDER BY col RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING))
      {_digest(f"SELECT cell, cdi, row, col, {value} AS v FROM b WHERE row BETWEEN 0 AND 49 AND col BETWEEN 0 AND 49 AND k > 0")}"""


_VAR = "greatest(q / k - (s / k) * (s / k), 0)"
_W = "PARTITION BY cell, cdi, {a} ORDER BY {b}"
_NEAR = f"(SELECT a.cell, a.cdi, a.row, a.col, b.row - a.row AS dr, b.col - a.col AS dc, b.v FROM (SELECT cell, cdi, r AS row, c AS col FROM (SELECT DISTINCT cell, cdi FROM {_MEAN}), (SELECT unnest(range(50)) AS r), (SELECT unnest(range(50)) AS c)) a JOIN {_MEAN} b ON a.cell = b.cell AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1)"
_GAUSS = "(SELECT CAST(d AS INT) AS d, w / sum(w) OVER () AS w FROM (SELECT d, exp(-0.5 * (d / CAST(1.5 AS DOUBLE)) ** 2) AS w FROM (SELECT unnest(range(-6, 7)) AS d)))"
_MD = f"(SELECT g.cell, g.cdi, g.row, g.col, p.v FROM (SELECT cell, cdi, r AS row, c AS col FROM (SELECT DISTINCT cell, cdi FROM {_MEAN}), (SELECT unnest(range(50)) AS r), (SELECT unnest(range(50)) AS c)) g LEFT JOIN {_MEAN} p ON g.cell = p.cell AND g.row = p.row AND g.col = p.col)"


def _slope(axis: str) -> str:
    w = f"OVER (PARTITION BY cell, cdi, {'col' if axis == 'row' else 'row'} ORDER BY {axis})"
    return f"CASE WHEN {axis} = 0 THEN lead(v) {w} - v WHEN {axis} = 49 THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END"


ORACLES = {
    "local_spread": _window(10, f"sqrt({_VAR})"),
    "local_variance": _window(5, _VAR),
    "local_extremes": _digest(f"""SELECT cell, cdi, row, col, max(hi) OVER w - min(lo) OVER w AS v FROM (SELECT cell, cdi, row, col, max(v) OVER w AS hi, min(v) OVER w AS lo FROM {_DENSE}
      WINDOW w AS (PARTITION BY cell, cdi, col ORDER BY row RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)) WINDOW w AS (PARTITION BY cell, cdi, row ORDER BY col RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)"""),
    "sobel": _digest(f"""SELECT cell, cdi, row, col, sqrt(gx * gx + gy * gy) AS v FROM (SELECT cell, cdi, row, col, sum(-dc * (2 - abs(dr)) * v) AS gx, sum(-dr * (2 - abs(dc)) * v) AS gy,
      count(CASE WHEN dr <> 0 OR dc <> 0 THEN 1 END) AS k FROM {_NEAR} GROUP BY ALL) WHERE k = 8"""),
    "gradient": _digest(f"SELECT cell, cdi, row, col, sqrt(a * a + b * b) AS v FROM (SELECT cell, cdi, row, col, {_slope('row')} AS a, {_slope('col')} AS b FROM {_MD})"),
    "gaussian": f"""WITH g AS {_GAUSS}, m AS {_mirror(P, 6)}, r AS (SELECT cell, cdi, row + d AS row, col, sum(v * w) AS a, sum(w) AS b FROM m, g GROUP BY ALL),
      c AS (SELECT cell, cdi, row, col + d AS col, sum(a * w) AS a, sum(b * w) AS b FROM r, g WHERE row BETWEEN 0 AND 49 GROUP BY ALL)
      {_digest('SELECT cell, cdi, row, col, a / b AS v FROM c WHERE col BETWEEN 0 AND 49')}""",
    "smooth_fill": f"""WITH g AS {_GAUSS}, m AS {_mirror(P, 6, True)}, r AS (SELECT cell, cdi, row + d AS row, col, sum(v * w) AS a, sum(w) AS b FROM m, g GROUP BY ALL),
      c AS (SELECT cell, cdi, row, col + d AS col, sum(a * w) AS a, sum(b * w) AS b FROM r, g WHERE row BETWEEN 0 AND 49 GROUP BY ALL)
      {_digest(f'SELECT c.cell, c.cdi, c.row, c.col, coalesce(p.v, a / b) AS v FROM c LEFT JOIN {P} p ON c.cell = p.cell AND c.cdi = p.cdi AND c.row = p.row AND c.col = p.col WHERE c.col BETWEEN 0 AND 49')}""",
    "relative_response": tables.text(f"""WITH r AS (SELECT cdi, CAST(floor(e) % 180 AS INT) AS angle, avg(depth) AS v FROM ({tables.SOUNDINGS}) GROUP BY ALL),
      h AS (SELECT a.cdi, a.angle, a.v - avg(b.v) AS height FROM r a JOIN r b ON a.cdi = b.cdi AND (b.angle - a.angle + 364) % 180 < 8 GROUP BY a.cdi, a.angle, a.v)
      SELECT cdi, angle, round(height, 9) AS height FROM h QUALIFY row_number() OVER (PARTITION BY cdi ORDER BY round(height, 9) DESC, angle) = 1"""),
    "label_regions": f"""WITH RECURSIVE p AS (SELECT cell, cdi, row, col FROM {P} WHERE v > 50), e AS (SELECT a.cell, a.cdi, a.row * 50 + a.col AS x, b.row * 50 + b.col AS y FROM p a JOIN p b ON a.cell = b.cell AND a.cdi = b.cdi
        AND abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1),
      t AS (SELECT cell, cdi, row * 50 + col AS x, row * 50 + col AS y FROM p UNION SELECT t.cell, t.cdi, t.x, e.y FROM t JOIN e ON t.cell = e.cell AND t.cdi = e.cdi AND t.y = e.x),
      r AS (SELECT cell, cdi, region, count(*) AS n FROM (SELECT cell, cdi, x, min(y) AS region FROM t GROUP BY ALL) GROUP BY ALL)
      SELECT cell, cdi, count(*) AS regions, max(n) AS largest, CAST(sum(n * n) AS BIGINT) AS squares FROM r GROUP BY ALL""",
    "closed_labels": f"""WITH m AS (SELECT cell, cdi, row, col, CASE WHEN v > 70 THEN 1 ELSE 0 END AS v FROM {_DENSE}),
      a AS (SELECT cell, cdi, row, col, max(v) OVER (PARTITION BY cell, cdi, col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM m),
      b AS (SELECT cell, cdi, row, col, CASE WHEN row NOT BETWEEN 2 AND 47 OR col NOT BETWEEN 2 AND 47 THEN 1 ELSE max(v) OVER (PARTITION BY cell, cdi, row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS v FROM a),
      c AS (SELECT cell, cdi, row, col, min(v) OVER (PARTITION BY cell, cdi, col ORDER BY row RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM b),
      d AS (SELECT cell, cdi, row, col, min(v) OVER (PARTITION BY cell, cdi, row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM c)
      SELECT cell, cdi, before, after FROM (SELECT cell, cdi, CAST(sum(v) AS BIGINT) AS before FROM m GROUP BY ALL) JOIN (SELECT cell, cdi, CAST(sum(v) AS BIGINT) AS after FROM d GROUP BY ALL) USING (cell, cdi)""",
}
