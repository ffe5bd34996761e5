"""Queries over survey pairs, the cost map and its layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import change, costmap, focal, labels, raster

from . import tables
from .tables import COLS, ROWS

P, S = (tables.text(f"({q})") for q in (tables.PIXELS, tables.SOUNDINGS))
TOTAL = ROWS * COLS
#: Added before rounding: means of numbers with few digits often lie between two roundings.
OFF = 3.7e-8
# The flagship's own pixels: one grid of 50 x 50 and four surveys.
FLAG_POINTS = """SELECT CAST(l_suppkey % 4 AS BIGINT) AS cdi, CAST((l_orderkey * 7 + l_linenumber * 13) % 50 AS INT) AS row,
  CAST((l_partkey * 11 + l_linenumber * 5) % 50 AS INT) AS col, CAST(2000 + 3 * (l_suppkey % 4) AS INT) AS year,
  l_extendedprice / 1000 AS depth, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4 FROM {lineitem}"""


def pair_change_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean, spread and 95th percentile of depth change between the surveys of each pair."""
    points = spark.sql(FLAG_POINTS, lineitem=tables.read(spark, sf_dir, "lineitem"))
    last = F.max_by("depth", F.struct("k1", "k2", "k3", "k4", "depth"))
    pixels = points.groupBy("cdi", "year", "row", "col").agg(last.alias("v"))
    found = change.pair_statistics(change.pairs(pixels, ()), ("id_old", "id_new"))
    return found.select(F.col("id_old").alias("s_old"), F.col("id_new").alias("s_new"), "n", *(F.round(c, 4).alias(c) for c in ("bias", "sd", "rmse", "p95")))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.covered(change.pairs(tables.pixels(spark, sf_dir)), TOTAL, 0.1)


def pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change a year about each pair's mean, of pairs that share a tenth of the pixels; by cell and pair."""
    p = _pairs(spark, sf_dir)
    a, s = change.rates(p), change.rates(p, signed=True)
    a = a.groupBy(*change.PAIR).agg(F.count("v").alias("n"), F.round(F.avg("v"), 9).alias("amplitude"), F.round(F.max("v"), 9).alias("most"))
    s = s.groupBy(*change.PAIR).agg(F.round(change.symmetric_limit(F.col("v")), 9).alias("limit"))
    return a.join(s, list(change.PAIR))


def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs i < j of each cell, the older one first; those of one year left out."""
    t = tables.pixels(spark, sf_dir).select("cell", "cdi", "year").distinct()
    b = t.select("cell", F.col("cdi").alias("id_b"), F.col("year").alias("year_b"))
    both = t.join(b, "cell").where("cdi < id_b AND year <> year_b")
    older = F.least(F.struct("year", "cdi"), F.struct(F.col("year_b").alias("year"), F.col("id_b").alias("cdi")))
    newer = F.greatest(F.struct("year", "cdi"), F.struct(F.col("year_b").alias("year"), F.col("id_b").alias("cdi")))
    return both.select("cell", older["cdi"].alias("id_old"), newer["cdi"].alias("id_new"), (newer["year"] - older["year"]).alias("dt"))


def _tile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.tile_pairs(raster.to_tiles(tables.pixels(spark, sf_dir), ROWS, COLS, ("cell", "cdi", "year")))


def best_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two surveys of a cell, the shift of up to 30 pixels each way at which the mean difference is smallest."""
    return change.best_shifts(_tile_pairs(spark, sf_dir)).withColumn("mean", F.round(F.col("mean") + OFF, 6))


def shift_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two surveys of a cell: shifts at which pixels meet, how many do in all, and the least and the largest mean difference."""
    s = change.shift_scores(_tile_pairs(spark, sf_dir)).groupBy(*change.PAIR)
    return s.agg(F.count(F.lit(1)).alias("shifts"), F.sum("n").alias("met"), F.round(F.min("mean") + OFF, 6).alias("least"), F.round(F.max("mean") + OFF, 6).alias("most"))


def survey_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle of each tile's steepest trend, in one array a survey."""
    p = tables.pixels(spark, sf_dir).groupBy("cdi", "cell")
    a = p.agg(F.round(F.degrees(F.atan2(F.covar_pop("row", "v"), F.covar_pop("col", "v"))), 6).alias("angle"))
    a = a.groupBy("cdi").agg(F.sort_array(F.collect_list(F.struct("cell", "angle"))).alias("a"))
    return a.select("cdi", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda x: F.concat(x["cell"].cast("string"), F.lit(":"), F.round(x["angle"]).cast("int").cast("string"))), ",").alias("angles"))


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bathymetry, amplitude and spread of all cells on one map."""
    p = tables.pixels(spark, sf_dir)
    place = lambda df: costmap.placed(raster.block_reduce(raster.flipped(df, ROWS), 5, "max"))
    rates = change.rates(_pairs(spark, sf_dir)).select("cell", "row", "col", "v")
    spread = p.groupBy("cell", "row", "col").agg(F.var_pop("v").alias("v")).withColumn("v", F.log10(F.sqrt("v") + 1))
    return place(raster.combine(p, "mean")), place(raster.combine(rates, "max")), place(spread)


def layered_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds, sum of the layers where there is bathymetry, a blocked part, an edited part, and the rest filled."""
    base, amplitude, spread = _layers(spark, sf_dir)
    one = base.withColumn("v", F.when(F.col("v").isNotNull(), F.lit(1.0)))
    total = costmap.layer_sum(one, costmap.flagged(amplitude, 9.0), costmap.flagged(spread, 1.5))
    total = costmap.with_nulls_of(total, base)
    total = costmap.add_cost(total, costmap.window(2, 3, 5, 9), 0.5)
    total = costmap.multiply_cost(total, costmap.window(4, 60, 8, 70), 2.0)
    total = costmap.set_cost(total, costmap.window(0, 0), 7.0)
    total = costmap.blocked(total, base.where("v > 103").select("row", "col"))
    return costmap.filled_high(total).withColumn("v", F.round("v", 6))


def flagged_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the map above each of five thresholds."""
    _, _, spread = _layers(spark, sf_dir)
    return costmap.flagged_shares(spread, [1.2, 1.3, 1.4, 1.5, 1.6]).withColumn("share", F.round("share", 9))


def label_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 1, 0 and -1 by survey: their mean with and without the missing ones, and whole-block maxima."""
    p = tables.pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") > 80, 1.0).when(F.col("v") > 5, 0.0).otherwise(-1.0))
    mean = p.groupBy("cdi", "cell").agg(F.round(F.avg("v"), 9).alias("with_missing"))
    q = costmap.label_cost(p)
    clean = q.groupBy("cdi", "cell").agg(F.round(F.avg("v"), 9).alias("share"))
    whole = raster.block_reduce(q, 2, "whole_max", ("cdi", "cell")).groupBy("cdi", "cell").agg(F.count("v").alias("whole"), F.sum("v").alias("marked"))
    return mean.join(clean, ["cdi", "cell"]).join(whole, ["cdi", "cell"])


def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each pixel, standardised, by cell."""
    p = raster.demeaned(tables.pixels(spark, sf_dir).select("cell", "cdi", "row", "col", "v"))
    f = p.withColumns({"f1": F.sqrt(F.abs("v")), "f2": F.sqrt(F.abs(F.col("v") - F.col("row") + F.col("col")))})
    s = labels.standardised(f, ["f1", "f2"])
    return s.groupBy("cell").agg(F.round(F.avg("f1"), 6).alias("m1"), F.round(F.avg("f2"), 6).alias("m2"), F.round(F.stddev_pop("f1"), 6).alias("s1"), F.count(F.lit(1)).alias("n"))


def bounded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of the embeddings' first components, neither below a twentieth; by label."""
    e = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(4)))
    found = labels.two_means(e.withColumnRenamed("label", "kind"), [f"f{i}" for i in range(4)], ["vec_id"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("minority"))


QUERIES = {
    f.__name__: f
    for f in (pair_change_stats, pair_rates, unordered_pairs, best_shift, shift_range, survey_angles, layered_cost, flagged_shares, label_reduction, feature_scaling, bounded_clusters)
}

_F = tables.text(f"({FLAG_POINTS})")
_PAIRS = f"""(SELECT *, avg(diff) OVER w AS m, count(*) OVER w AS k FROM (SELECT a.cell, a.row, a.col, a.cdi AS id_old, b.cdi AS id_new, b.year - a.year AS dt, b.v - a.v AS diff
  FROM {P} a JOIN {P} b ON a.cell = b.cell AND a.row = b.row AND a.col = b.col AND b.year > a.year) WINDOW w AS (PARTITION BY cell, id_old, id_new, dt) QUALIFY count(*) OVER w > {TOTAL // 10})"""


def _placed(q: str) -> str:
    return f"(SELECT (49 - row) // 5 + cell // 16 * 50 AS row, col // 5 + cell % 16 * 50 AS col, max(v) AS v FROM {q} GROUP BY cell, (49 - row) // 5, col // 5)"


_BASE = _placed(f"(SELECT cell, row, col, avg(v) AS v FROM {P} GROUP BY ALL)")
_AMP = _placed(f"(SELECT cell, row, col, max(abs(diff - m) / dt) AS v FROM {_PAIRS} GROUP BY ALL)")
_SPREAD = _placed(f"(SELECT cell, row, col, log10(sqrt(var_pop(v)) + 1) AS v FROM {P} GROUP BY ALL)")
_LAB = f"(SELECT cdi, cell, row, col, CASE WHEN v > 80 THEN 1 WHEN v > 5 THEN 0 ELSE -1 END AS v FROM {P})"
_SHIFTED = f"""WITH p AS (SELECT cell, cdi, year, row, col, v FROM {P}), m AS (SELECT cell, cdi, avg(v) AS m FROM p GROUP BY ALL),
  o AS (SELECT a.cell, a.cdi AS id_old, b.cdi AS id_new, b.m - a.m AS m FROM m a JOIN m b ON a.cell = b.cell),
  s AS (SELECT a.cell, a.cdi AS id_old, b.cdi AS id_new, b.year - a.year AS dt, b.row - a.row AS dy, b.col - a.col AS dx, count(*) AS n, avg(b.v - a.v) AS mean
        FROM p a JOIN p b ON a.cell = b.cell AND b.year > a.year AND b.row BETWEEN a.row - 30 AND a.row + 30 AND b.col BETWEEN a.col - 30 AND a.col + 30 GROUP BY ALL)"""
ORACLES = {
    "pair_change_stats": f"""WITH p AS (SELECT cdi, year, row, col, depth AS v FROM (SELECT *, row_number() OVER (PARTITION BY cdi, row, col ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, depth DESC) AS rn FROM {_F}) WHERE rn = 1),
      d AS (SELECT a.cdi AS s_old, b.cdi AS s_new, b.v - a.v AS d FROM p a JOIN p b ON a.row = b.row AND a.col = b.col AND b.year > a.year)
      SELECT s_old, s_new, count(*) AS n, round(avg(d), 4) AS bias, round(stddev_pop(d), 4) AS sd, round(sqrt(avg(d * d)), 4) AS rmse, round(quantile_cont(abs(d), 0.95), 4) AS p95 FROM d GROUP BY ALL""",
    "pair_rates": f"""SELECT cell, id_old, id_new, dt, count(*) AS n, round(avg(abs(diff - m) / dt), 9) AS amplitude, round(max(abs(diff - m) / dt), 9) AS most, round(greatest(-min((diff - m) / dt), max((diff - m) / dt)), 9) AS "limit" FROM {_PAIRS} GROUP BY ALL""",
    "unordered_pairs": f"WITH t AS (SELECT DISTINCT cell, cdi, year FROM {P}) SELECT a.cell, a.cdi AS id_old, b.cdi AS id_new, b.year - a.year AS dt FROM t a JOIN t b ON a.cell = b.cell AND a.year < b.year",
    "best_shift": f"""{_SHIFTED} SELECT cell, id_old, id_new, dt, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, n, round(round(mean - m, 9) + CAST({OFF} AS DOUBLE), 6) AS mean FROM s JOIN o USING (cell, id_old, id_new)
      QUALIFY row_number() OVER (PARTITION BY cell, id_old, id_new ORDER BY round(mean - m, 9), dx, dy) = 1""",
    "shift_range": f"""{_SHIFTED} SELECT cell, id_old, id_new, dt, count(*) AS shifts, CAST(sum(n) AS BIGINT) AS met, round(min(mean) + CAST({OFF} AS DOUBLE), 6) AS least, round(max(mean) + CAST({OFF} AS DOUBLE), 6) AS most FROM s GROUP BY ALL""",
    "survey_angles": f"""SELECT cdi, count(*) AS n, string_agg(concat(cell, ':', CAST(round(angle) AS INT)), ',' ORDER BY cell) AS angles FROM
      (SELECT cdi, cell, round(degrees(atan2(covar_pop(row, v), covar_pop(col, v))), 6) AS angle FROM {P} GROUP BY ALL) GROUP BY cdi""",
    "layered_cost": f"""WITH b AS {_BASE}, t AS (SELECT row, col, sum(v) AS v FROM (SELECT row, col, CAST(1 AS DOUBLE) AS v FROM b UNION ALL SELECT row, col, CASE WHEN v > 9 THEN 1 END FROM {_AMP}
        UNION ALL SELECT row, col, CASE WHEN v > 1.5 THEN 1 END FROM {_SPREAD}) GROUP BY ALL),
      n AS (SELECT t.row, t.col, CASE WHEN b.v IS NOT NULL THEN t.v END AS v, b.v AS d FROM t LEFT JOIN b ON t.row = b.row AND t.col = b.col),
      e AS (SELECT row, col, d, CASE WHEN row BETWEEN 2 AND 4 AND col BETWEEN 3 AND 8 THEN coalesce(v, 0) + 0.5 ELSE v END AS v FROM n),
      f AS (SELECT row, col, d, CASE WHEN row BETWEEN 4 AND 7 AND col BETWEEN 60 AND 69 THEN v * 2 WHEN row = 0 AND col = 0 THEN 7 ELSE v END AS v FROM e),
      g AS (SELECT row, col, CASE WHEN d > 103 THEN -1 ELSE v END AS v FROM f)
      SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(CAST(coalesce(v, (SELECT max(v) FROM g)) AS DOUBLE), 6) AS v FROM g""",
    "flagged_shares": f"SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN v > t THEN 1 ELSE 0 END), 9) AS share FROM {_SPREAD}, (SELECT unnest([CAST(1.2 AS DOUBLE), 1.3, 1.4, 1.5, 1.6]) AS t) WHERE v IS NOT NULL GROUP BY t",
    "label_reduction": f"""WITH l AS {_LAB}, b AS (SELECT cdi, cell, CASE WHEN count(nullif(v, -1)) = 4 THEN max(v) END AS v FROM l GROUP BY cdi, cell, row // 2, col // 2)
      SELECT cdi, cell, with_missing, share, whole, marked FROM (SELECT cdi, cell, round(avg(v), 9) AS with_missing, round(avg(nullif(v, -1)), 9) AS share FROM l GROUP BY ALL)
      JOIN (SELECT cdi, cell, count(v) AS whole, CAST(sum(v) AS DOUBLE) AS marked FROM b GROUP BY ALL) USING (cdi, cell)""",
    "feature_scaling": f"""WITH m AS (SELECT *, v - avg(v) OVER (PARTITION BY cell, cdi) AS d FROM {P}), f AS (SELECT cell, sqrt(abs(d)) AS f1, sqrt(abs(d - row + col)) AS f2 FROM m),
      s AS (SELECT avg(f1) AS a1, stddev_pop(f1) AS b1, avg(f2) AS a2, stddev_pop(f2) AS b2 FROM f)
      SELECT cell, round(avg((f1 - a1) / b1), 6) AS m1, round(avg((f2 - a2) / b2), 6) AS m2, round(stddev_pop((f1 - a1) / b1), 6) AS s1, count(*) AS n FROM f, s GROUP BY cell""",
}
