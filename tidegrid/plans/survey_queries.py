"""Further queries over tiles and routes: sweeps over window sizes, sets of pixels, snapping, profiles, shares and cost reductions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import change, focal, kernels, labels, quantiles, raster, routes

from . import focal_queries, map_queries, tables
from .tables import COLS, ROWS

P = tables.text(f"({tables.PIXELS})")
TILE = ("cell", "cdi")
SIZES, CLOSINGS, THRESHOLDS = (3, 5, 10, 20), (1, 2, 4), (30.0, 50.0, 70.0)
#: Headings and steps to wait that a state number holds.
HEADINGS, WAITS = 8, 2


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pixels(spark, sf_dir).select(*TILE, "row", "col", "v")


def local_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the values there are in windows of three, the edge pixel repeated."""
    m = focal.local_moments(_pixels(spark, sf_dir), 3, ROWS, COLS).withColumnRenamed("mean", "v")
    return focal_queries._by_row(m)


def spread_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard deviation in windows of several sizes: a digest of each tile and size."""
    p = _pixels(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"s{s}").alias("v")) for s in SIZES))).alias("s")
    return focal_queries._by_row(focal.local_stds(p, SIZES, ROWS, COLS).select(*TILE, "row", "col", each).select(*TILE, "row", "col", "s.*"), "size")


def closing_by_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep pixels after one, two and four closings, by tile."""
    m = focal_queries._dense(spark, sf_dir).withColumn("v", F.coalesce((F.col("v") > 70).cast("int"), F.lit(0)))
    return labels.closings(m, CLOSINGS, ROWS, COLS).select(*TILE, "after", "times")


def threshold_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many deviations each threshold lies from a cell's median, and the share of its pixels above."""
    p = _pixels(spark, sf_dir)
    mid = quantiles.wide(quantiles.quantiles(p, "v", (0.5,), ("cell",)), ("cell",), {0.5: "mid"})
    about = p.groupBy("cell").agg(F.stddev_pop("v").alias("sd")).join(mid, "cell")
    t = p.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).groupBy("cell", "threshold").agg(F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("share"))
    return t.join(about, "cell").select("cell", "threshold", F.round((F.col("threshold") - F.col("mid")) / F.col("sd"), 8).alias("sigmas"), F.round("share", 9).alias("share"))


def label_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label of a tile, with -1 for no data counted and not counted."""
    d = focal_queries._dense(spark, sf_dir).withColumn("label", F.when(F.col("v").isNull(), -1).otherwise((F.col("v") > 50).cast("int")))
    return d.groupBy(*TILE).agg(F.round(F.avg("label"), 9).alias("with_none"), F.round(F.avg(F.nullif("label", F.lit(-1))), 9).alias("ratio"))


def pixels_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that surveys 0 and 1 both have, and those that only survey 0 has, by cell."""
    p = _pixels(spark, sf_dir)
    a, b = (p.where(F.col("cdi") == i).select("cell", "row", "col") for i in (0, 1))
    both, only = a.intersect(b).withColumn("kind", F.lit("both")), a.exceptAll(b).withColumn("kind", F.lit("only"))
    return both.unionByName(only).groupBy("cell", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row") * COLS + F.col("col")).cast("long").alias("places"))


def snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid pixel of each tile nearest to its middle; of equal distances the first by row and column."""
    d2 = F.pow(F.col("row") - ROWS // 2, 2) + F.pow(F.col("col") - COLS // 2, 2)
    best = F.min(F.struct(d2.cast("long").alias("d2"), "row", "col", "v"))
    return _pixels(spark, sf_dir).groupBy(*TILE).agg(best.alias("b")).select(*TILE, "b.d2", "b.row", "b.col", F.round("b.v", 9).alias("v"))


def paired_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of each survey pair along a tile's middle row, and their difference."""
    p = tables.pixels(spark, sf_dir).where(F.col("row") == ROWS // 2)
    d = change.pairs(p).select("cell", "id_old", "id_new", "col", *(F.round(c, 9).alias(c) for c in ("old", "new", "diff")))
    return d


def first_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change from each cell's first year to its last, and the limit of a scale that is symmetric about 0."""
    p = tables.pixels(spark, sf_dir)
    ends = p.groupBy("cell").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    d = change.pairs(p.join(ends, "cell").where("year = a OR year = b").select("cell", "cdi", "year", "row", "col", "v"))
    return d.groupBy("cell", "dt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 8).alias("mean"), F.round(change.symmetric_limit(F.col("diff")), 9).alias("limit"))


def cost_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each route's cells, and by how many per cent it is below the dearest of its scenario."""
    w = map_queries._walks(spark, sf_dir)
    cost = routes.mask_cost(w, map_queries._layer(spark, sf_dir)).withColumn("scenario", (F.col("run_id") % 5).cast("int"))
    top = cost.groupBy("scenario").agg(F.max("cost").alias("most"))
    return cost.join(top, "scenario").select("run_id", "scenario", F.round("cost", 6).alias("cost"), F.round(100 * (F.col("most") - F.col("cost")) / F.abs("most"), 6).alias("reduction"))


def state_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search states (row, col, heading, wait) of the routes as numbers, and what comes back from the numbers."""
    s = map_queries._walks(spark, sf_dir).withColumn("wait", F.col("step") % WAITS)
    n = ((F.col("row") * COLS + F.col("col")) * HEADINGS + F.col("heading")) * WAITS + F.col("wait")
    s = s.select("run_id", "step", n.cast("long").alias("state"))
    back = {"row": f"state div {COLS * HEADINGS * WAITS}", "col": f"state div {HEADINGS * WAITS} % {COLS}", "heading": f"state div {WAITS} % {HEADINGS}", "wait": f"state % {WAITS}"}
    return s.select("run_id", "step", "state", *(F.expr(f"CAST({e} AS INT)").alias(c) for c, e in back.items()))


def limited_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's mean raster with gaps of up to six pixels filled from the nearest value: pixels before and after."""
    t = raster.to_tiles(raster.combine(tables.pixels(spark, sf_dir), "mean"), ROWS, COLS, ("cell",))
    after = kernels.on_tiles(t, lambda a: kernels.filled_gaps(a, 6), ("cell",))
    count = "size(filter(data, x -> x IS NOT NULL))"
    return t.select("cell", F.expr(count).alias("before")).join(after.select("cell", F.expr(count).alias("after"), F.expr("round(aggregate(data, 0D, (s, x) -> s + coalesce(x, 0D)), 5)").alias("total")), "cell")


QUERIES = {
    f.__name__: f
    for f in (
        local_mean, spread_by_size, closing_by_times, threshold_sigmas, label_ratio, pixels_of_both, snapped, paired_profile, first_to_last,
        cost_reduction, state_numbers, limited_fill,
    )
}

_D = focal_queries._DENSE


def _closing(t: int) -> str:
    span = f"RANGE BETWEEN {t} PRECEDING AND {t} FOLLOWING"
    edge = f"row NOT BETWEEN {t} AND {49 - t} OR col NOT BETWEEN {t} AND {49 - t}"
    return f"""SELECT cell, cdi, CAST(sum(v) AS BIGINT) AS after, {t} AS times FROM (SELECT cell, cdi, row, min(v) OVER (PARTITION BY cell, cdi, row ORDER BY col {span}) AS v FROM (SELECT cell, cdi, row, col, min(v) OVER (PARTITION BY cell, cdi, col ORDER BY row {span}) AS v FROM
      (SELECT cell, cdi, row, col, CASE WHEN {edge} THEN 1 ELSE max(v) OVER (PARTITION BY cell, cdi, row ORDER BY col {span}) END AS v FROM (SELECT cell, cdi, row, col, max(v) OVER (PARTITION BY cell, cdi, col ORDER BY row {span}) AS v FROM
      (SELECT cell, cdi, row, col, CASE WHEN v > 70 THEN 1 ELSE 0 END AS v FROM {_D}))))) GROUP BY ALL"""


_PAIRS = f"(SELECT a.cell, a.row, a.col, a.cdi AS id_old, b.cdi AS id_new, b.year - a.year AS dt, a.v AS old, b.v AS new, b.v - a.v AS diff, a.year AS y0, b.year AS y1 FROM {P} a JOIN {P} b ON a.cell = b.cell AND a.row = b.row AND a.col = b.col AND b.year > a.year)"

ORACLES = {
    "local_mean": focal_queries._window(3, "s / k"),
    "spread_by_size": " UNION ALL ".join(f"SELECT *, {s} AS size FROM ({focal_queries._window(s, f'sqrt({focal_queries._VAR})')})" for s in SIZES),
    "closing_by_times": " UNION ALL ".join(map(_closing, CLOSINGS)),
    "threshold_sigmas": f"""WITH a AS (SELECT cell, median(v) AS mid, stddev_pop(v) AS sd FROM {P} GROUP BY cell), t AS (SELECT cell, threshold, avg(CASE WHEN v > threshold THEN 1.0 ELSE 0 END) AS share
        FROM {P}, (SELECT CAST(unnest([{', '.join(map(str, THRESHOLDS))}]) AS DOUBLE) AS threshold) GROUP BY ALL)
      SELECT cell, threshold, round((threshold - mid) / sd, 8) AS sigmas, round(share, 9) AS share FROM t JOIN a USING (cell)""",
    "label_ratio": f"""SELECT cell, cdi, round(avg(label), 9) AS with_none, round(avg(nullif(label, -1)), 9) AS ratio FROM (SELECT cell, cdi, CASE WHEN v IS NULL THEN -1 WHEN v > 50 THEN 1 ELSE 0 END AS label FROM {_D}) GROUP BY ALL""",
    "pixels_of_both": f"""WITH a AS (SELECT cell, row, col FROM {P} WHERE cdi = 0), b AS (SELECT cell, row, col FROM {P} WHERE cdi = 1)
      SELECT cell, kind, count(*) AS n, CAST(sum(row * 50 + col) AS BIGINT) AS places FROM (SELECT *, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'only' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY ALL""",
    "snapped": f"""SELECT cell, cdi, d2, row, col, round(v, 9) AS v FROM (SELECT *, CAST((row - 25) ** 2 + (col - 25) ** 2 AS BIGINT) AS d2 FROM {P}) QUALIFY row_number() OVER (PARTITION BY cell, cdi ORDER BY d2, row, col) = 1""",
    "paired_profile": f"SELECT cell, id_old, id_new, col, round(old, 9) AS old, round(new, 9) AS new, round(diff, 9) AS diff FROM {_PAIRS} WHERE row = 25",
    "first_to_last": f"""WITH e AS (SELECT cell, min(year) AS a, max(year) AS b FROM {P} GROUP BY cell)
      SELECT cell, dt, count(*) AS n, round(avg(diff), 8) AS mean, round(greatest(-min(diff), max(diff)), 9) AS "limit" FROM {_PAIRS} JOIN e USING (cell) WHERE y0 = a AND y1 = b GROUP BY ALL""",
    "cost_reduction": f"""WITH c AS (SELECT run_id, CAST(run_id % 5 AS INT) AS scenario, sum(v) AS cost FROM (SELECT DISTINCT run_id, row, col FROM {map_queries._WALKS}) JOIN {map_queries._LAYER} USING (row, col) GROUP BY run_id)
      SELECT run_id, scenario, round(cost, 6) AS cost, round(100 * (max(cost) OVER (PARTITION BY scenario) - cost) / abs(max(cost) OVER (PARTITION BY scenario)), 6) AS reduction FROM c""",
    "state_numbers": f"""SELECT run_id, step, CAST(((row * 50 + col) * 8 + heading) * 2 + step % 2 AS BIGINT) AS state, row, col, heading, CAST(step % 2 AS INT) AS wait FROM {map_queries._WALKS}""",
}
