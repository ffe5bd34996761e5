"""Sweeps over the parameters of filling, detrending, notches and closings, zoomed rasters, scenarios of routes and recorded searches."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import change, costmap, focal, kernels, labels, raster, routes, spectra

from . import focal_queries, map_queries, survey_queries, tables
from .tables import COLS, ROWS

P = focal_queries.P
TILE = ("cell", "cdi")
TIMES = (1, 2, 5)
START, GOAL = (2, 2), (46, 45)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _swept(spark: SparkSession, sf_dir: str, f, name: str, values, columns) -> DataFrame:
    return _rounded(spectra.sweep(focal_queries._tiles(spark, sf_dir), f, name, values, columns))


def fill_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each tile after each stage of filling."""
    f = lambda a, s: (lambda b: (b.mean(), b.std()))(spectra.fill_stages(a)[s])
    return _swept(spark, sf_dir, f, "stage", ("nearest", "surface", "blended", "smoothed"), ("mean", "sd"))


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from data, and the share of the surface in the filling, for several reaches: mean and largest of a tile."""

    def f(a: np.ndarray, reach: float):
        d, _ = kernels.nearest(np.isfinite(a))
        t = np.clip(d / reach, 0, 1) ** 2
        return d.mean(), d.max(), t.mean(), t.max()

    return _swept(spark, sf_dir, f, "reach", (5.0, 15.0, 30.0, 60.0), ("distance", "furthest", "weight", "heaviest"))


def detrend_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of trend and residual, and the share of the spectrum's amplitude in the residual, by width of the Gaussian."""

    def f(a: np.ndarray, sigma: float):
        trend, rest = spectra.detrended(a, sigma)
        t, r = (np.abs(spectra.transformed(x, "hann", "half")).sum() for x in (trend, rest))
        return trend.std(), rest.std(), r / (r + t) if r + t else np.nan

    return _swept(spark, sf_dir, f, "sigma", (1.0, 4.0, 6.0, 10.0), ("trend", "residual", "share"))


def spectrum_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-amplitude of each detrended tile: as it is, under each window, and padded in each way."""
    how = {"raw": (None, "none"), **{w: (w, "none") for w in ("hann", "hamming", "tukey")}, **{p: ("hann", p) for p in ("half", "whole", "power")}}

    def f(a: np.ndarray, stage: str):
        s = np.log(np.abs(spectra.transformed(spectra.detrended(a, 6.0)[1], *how[stage])) + 1)
        return s.size, s.mean(), s.max()

    return _swept(spark, sf_dir, f, "stage", tuple(how), ("n", "mean", "most"))


def notch_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log-amplitude in a band along the horizontal axis, and the tile's deviation without it, by width."""

    def f(a: np.ndarray, width: float):
        s = kernels.spectrum(spectra.detrended(a, 6.0)[1])
        return np.log(np.abs(s) + 1)[kernels.band(s.shape, 0.0, width, 15.0)].mean(), np.nanstd(kernels.destriped(a, 0.0, 6.0, width))

    return _swept(spark, sf_dir, f, "width", (1.0, 3.0, 5.0, 8.0), ("energy", "sd"))


def notch_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each detrended tile's deviation after a notch of each shape."""

    def f(a: np.ndarray, shape: str):
        rest = spectra.detrended(a, 6.0)[1]
        s = spectra.transformed(rest, None, "power")
        notch = {"line": lambda: ~spectra.axis_notch(s.shape, 5, False), "cross": lambda: ~spectra.axis_notch(s.shape), "gaussian": lambda: spectra.gaussian_notch(s.shape), "cone": lambda: ~spectra.cone(s.shape, 45.0)}[shape]()
        return rest.std(), spectra.restored(s * notch, rest.shape, "power").std()

    return _swept(spark, sf_dir, f, "shape", ("line", "cross", "gaussian", "cone"), ("before", "after"))


def window_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation at the edge against that inside, of tiles notched with a window and without."""

    def f(a: np.ndarray, window: str):
        w = None if window == "none" else window
        rest = spectra.detrended(a, 6.0)[1]
        s = spectra.transformed(rest, w, "half")
        out = spectra.restored(s * ~kernels.band(s.shape, 0.0, 5.0, 15.0), rest.shape, "half", w)
        edge = np.pad(np.zeros((ROWS - 10, COLS - 10), bool), 5, constant_values=True)
        return out[edge].std(), out[~edge].std()

    return _swept(spark, sf_dir, f, "window", ("none", "hann", "tukey"), ("edge", "inside"))


def low_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the lowest frequencies of each tile, and of the rest."""

    def f(a: np.ndarray, cutoff: int):
        whole = kernels.filled(a)
        whole = whole - whole.mean()
        low = spectra.low_passed(whole, cutoff)
        return low.std(), (whole - low).std()

    return _swept(spark, sf_dir, f, "cutoff", (2, 4, 8), ("low", "rest"))


def angle_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest direction of each tile by cones and by crosses, with its response."""
    f = lambda a, how: spectra.cone_angle(a) if how == "cone" else spectra.cross_angle(a, width=1.0, step=3.0)
    return _swept(spark, sf_dir, f, "how", ("cone", "cross"), ("angle", "response"))


def angle_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of every angle, and its height above the angles around."""
    r = kernels.angle_responses(focal_queries._tiles(spark, sf_dir))
    return _rounded(r.withColumnRenamed("v", "response").join(focal.relative_height(r, 180).select(*TILE, "angle", "height"), [*TILE, "angle"]))


def plain_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plain clusters of pixels by depth and roughness: how many, and their mean depth."""
    p = survey_queries._pixels(spark, sf_dir)
    f = focal.local_stds(p, (5, 10), ROWS, COLS)
    found = labels.plain_clusters(labels.standardised(f.withColumn("depth", F.col("v")), ["v", "s5", "s10"]), ["v", "s5", "s10"])
    return _rounded(found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("depth")))


def zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing pixels of each tile, and its mean with 0 for them."""
    d = focal_queries._dense(spark, sf_dir)
    return d.groupBy(*TILE).agg((F.count(F.lit(1)) - F.count("v")).alias("missing"), F.round(F.avg(F.coalesce("v", F.lit(0.0))), 8).alias("mean"))


def zoomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile, 0 where it has no data, at twice the resolution by bilinear interpolation: a digest."""
    z = raster.zoomed(survey_queries._pixels(spark, sf_dir), 2, ROWS, COLS)
    return z.where("abs(v) > 1e-9").groupBy(*TILE).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"), F.round(F.sum(F.col("v") * (F.col("row") * 2 * COLS + F.col("col"))) / 10000, 5).alias("moment"))


def erosion_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep pixels dilated and then eroded, several times over: pixels after each, and those eroded away."""
    m = focal_queries._dense(spark, sf_dir).withColumn("v", F.coalesce((F.col("v") > 70).cast("int"), F.lit(0)))
    return labels.closings(m, TIMES, ROWS, COLS).select(*TILE, "times", "dilated", "after", (F.col("dilated") - F.col("after")).alias("eroded"))


def change_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-roughness of the change of every survey pair, marked where it is over 2: the mean is the share marked. cdi names the pair."""
    d = change.pairs(tables.pixels(spark, sf_dir)).select("cell", (F.col("id_old") * 10 + F.col("id_new")).alias("cdi"), "row", "col", F.col("diff").alias("v"))
    s = focal.local_std(d, 10, ROWS, COLS)
    return focal_queries._by_row(s.withColumn("v", (F.log1p("v") > 2).cast("double")))


def cell_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle of each cell on the map of sixteen cells a row, and how many pixels of its mean raster are missing."""
    n = raster.combine(tables.pixels(spark, sf_dir), "mean").groupBy("cell").agg((ROWS * COLS - F.count("v")).alias("missing"))
    return n.select("cell", (555652 + 5000 * (F.col("cell") % 16) + 2500).cast("double").alias("x"), (5910512 + 5000 * F.floor(F.col("cell") / 16) + 2500).cast("double").alias("y"), "missing")


def survey_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each survey's start to its end; dates that don't exist give none."""
    start, end = (F.to_date(F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyyMMdd"))) for c in ("start_date", "end_date"))
    return tables.surveys(spark, sf_dir).select("cdi", F.datediff(end, start).cast("long").alias("days"))


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's mean raster, 100 where it has no data, as two maps: free, and without the deepest pixels. run_id is 2 * cell + scenario."""
    m = costmap.filled_high(raster.dense(raster.combine(tables.pixels(spark, sf_dir), "mean"), ROWS, COLS, ("cell",)), 100.0)
    two = m.withColumn("scenario", F.explode(F.array(F.lit(0), F.lit(1))))
    ends = reduce(Column.__or__, ((F.col("row") == r) & (F.col("col") == c) for r, c in (START, GOAL)))
    shut = (F.col("scenario") == 1) & F.col("v").between(60, 99) & ~ends
    return two.select((F.col("cell").cast("long") * 2 + F.col("scenario")).alias("run_id"), "row", "col", F.when(shut, -1.0).otherwise(F.col("v")).alias("v"))


def scenario_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each cell's route in both scenarios, and by how many per cent it is below that of the proposed way along the diagonal."""
    maps = _scenarios(spark, sf_dir)
    found = routes.routes(maps, ROWS, COLS, START, GOAL, turn=1, momentum=2).groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.max("g").alias("cost"))
    diagonal, last = F.when(F.expr("row = col AND row BETWEEN 3 AND 45"), F.col("v")), F.when((F.col("row") == GOAL[0]) & (F.col("col") == GOAL[1]), F.col("v"))
    proposed = maps.where("run_id % 2 = 0").groupBy(F.floor(F.col("run_id") / 2).alias("cell")).agg((F.sum(diagonal) * 2**0.5 + F.max(last)).alias("proposed"))
    out = found.withColumn("cell", F.floor(F.col("run_id") / 2)).join(proposed, "cell")
    return _rounded(out.select("cell", (F.col("run_id") % 2).cast("int").alias("scenario"), "steps", "cost", "proposed", (100 * (F.col("proposed") - F.col("cost")) / F.col("proposed")).alias("reduction")))


def search_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each cell's recorded search, one every 500 states: pixels seen so far and the dearest state settled."""
    seen = routes.searches(_scenarios(spark, sf_dir).where("run_id % 2 = 0"), ROWS, COLS, START, GOAL, turn=1, momentum=2)
    return seen.groupBy("run_id", F.floor(F.col("step") / 500).alias("frame")).agg(F.count_if("new").alias("new"), F.round(F.max("g"), 6).alias("g"))


def traced_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way through the pixels under each cell's two routes, from one corner to the other: steps and where they lead."""
    both = routes.routes(_scenarios(spark, sf_dir), ROWS, COLS, START, GOAL, turn=1, momentum=2)
    mask = both.select(F.floor(F.col("run_id") / 2).alias("run_id"), "row", "col").distinct()
    t = routes.traced(mask, (0, 0), (ROWS - 1, COLS - 1))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.max("row").alias("row"), F.max("col").alias("col"))


QUERIES = {
    f.__name__: f
    for f in (
        fill_stages, blend_weights, detrend_sigmas, spectrum_stages, notch_widths, notch_shapes, window_effect, low_passed, angle_sweeps, angle_curves,
        plain_clusters, zero_filled, zoomed, erosion_effect, change_roughness, cell_overview, survey_durations, scenario_costs, search_frames, traced_masks,
    )
}

_D = focal_queries._DENSE
_PAIRS = f"(SELECT a.cell, a.cdi * 10 + b.cdi AS cdi, a.row, a.col, b.v - a.v AS v FROM {P} a JOIN {P} b ON a.cell = b.cell AND a.row = b.row AND a.col = b.col AND b.year > a.year)"


def _dilated(t: int) -> str:
    span = f"RANGE BETWEEN {t} PRECEDING AND {t} FOLLOWING"
    return f"""SELECT cell, cdi, CAST(sum(v) AS BIGINT) AS dilated FROM (SELECT cell, cdi, max(v) OVER (PARTITION BY cell, cdi, row ORDER BY col {span}) AS v FROM
      (SELECT cell, cdi, row, col, max(v) OVER (PARTITION BY cell, cdi, col ORDER BY row {span}) AS v FROM (SELECT cell, cdi, row, col, CASE WHEN v > 70 THEN 1 ELSE 0 END AS v FROM {_D}))) GROUP BY ALL"""


def _bilinear(source: str, axis: str, other: str) -> str:
    at = f"CAST(i AS DOUBLE) * 49 / 99 - {axis}"
    return f"(SELECT cell, cdi, i AS {axis}, {other}, sum(v * (1 - abs({at}))) AS v FROM {source}, (SELECT unnest(range(100)) AS i) WHERE abs({at}) < 1 GROUP BY ALL)"


ORACLES = {
    "zero_filled": f"SELECT cell, cdi, count(*) - count(v) AS missing, round(avg(coalesce(v, 0)), 8) AS mean FROM {_D} GROUP BY ALL",
    "zoomed": f"SELECT cell, cdi, count(*) AS n, round(sum(v), 6) AS total, round(sum(v * (row * 100 + col)) / 10000, 5) AS moment FROM {_bilinear(_bilinear(P, 'row', 'col'), 'col', 'row')} WHERE abs(v) > 1e-9 GROUP BY ALL",
    "erosion_effect": " UNION ALL ".join(f"SELECT cell, cdi, times, dilated, after, dilated - after AS eroded FROM ({survey_queries._closing(t)}) JOIN ({_dilated(t)}) USING (cell, cdi)" for t in TIMES),
    "change_roughness": focal_queries._window(10, f"CASE WHEN ln(1 + sqrt({focal_queries._VAR})) > 2 THEN 1.0 ELSE 0.0 END").replace(P, _PAIRS),
    "cell_overview": f"SELECT cell, CAST(555652 + 5000 * (cell % 16) + 2500 AS DOUBLE) AS x, CAST(5910512 + 5000 * (cell // 16) + 2500 AS DOUBLE) AS y, 2500 - count(*) AS missing FROM (SELECT DISTINCT cell, row, col FROM {P}) GROUP BY cell",
    "survey_durations": f"SELECT cdi, CAST(date_diff('day', try_strptime(CAST(start_date AS VARCHAR), '%Y%m%d'), try_strptime(CAST(end_date AS VARCHAR), '%Y%m%d')) AS BIGINT) AS days FROM ({tables.text(tables.SURVEYS)})",
}
