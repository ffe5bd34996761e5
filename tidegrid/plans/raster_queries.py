"""Queries over soundings, surveys and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import quantiles, raster

from . import tables
from .tables import COLS, ROWS, SIZE

P, S, M = (tables.text(f"({q})") for q in (tables.PIXELS, tables.SOUNDINGS, tables.SURVEYS))
TOTAL = ROWS * COLS


def eligible_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata scan, file names, dates and eligibility."""
    s = tables.surveys(spark, sf_dir)
    day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    name = F.concat(F.lit("000574_XYZ_"), F.replace(F.replace("local_id", F.lit("/"), F.lit("_")), F.lit("v"), F.lit("V")), F.lit(".txt"))
    s = s.where((F.col("rejected") == 0) & (F.col("density") > 20))
    return s.select("cdi", name.alias("file_name"), F.substring(F.col("start_date").cast("string"), 1, 4).cast("int").alias("year"), F.date_diff(day("end_date"), day("start_date")).cast("long").alias("days"))


def rasterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last sounding of each pixel."""
    return tables.pixels(spark, sf_dir).select("cell", "cdi", "row", "col", F.round("v", 9).alias("v"))


def raster_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of the tile's box at which enough pixels are filled."""
    return raster.shift_search(tables.soundings(spark, sf_dir), SIZE, ROWS, COLS)


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, extent and median point of each survey."""
    s = tables.soundings(spark, sf_dir)
    places = s.select("cdi", F.explode(F.array(F.struct(F.lit("mid_e").alias("axis"), F.col("e").alias("v")), F.struct(F.lit("mid_n").alias("axis"), F.col("n").alias("v")))).alias("p"))
    mid = quantiles.quantiles(places.select("cdi", "p.*"), "v", (0.5,), ("cdi", "axis"))
    mid = mid.groupBy("cdi").agg(*(F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a) for a in ("mid_e", "mid_n")))
    about = s.groupBy("cdi").agg(F.min("e").alias("x0"), F.max("e").alias("x1"), F.min("n").alias("y0"), F.max("n").alias("y1"), (F.max("e") - F.min("e")).alias("width"), F.count(F.lit(1)).alias("n_points"))
    return about.join(mid, "cdi")


def survey_count_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys per pixel, counted once each."""
    return raster.survey_counts(tables.soundings(spark, sf_dir), 50.0, 0.0, 0.0, 20, 20)


def survey_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and mean count, and counts by ten bins of 0 to 5."""
    grid = survey_count_grid(spark, sf_dir)
    about = grid.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 9).alias("mean"))
    return raster.histogram(grid, "v", 0.0, 5.0, 10).crossJoin(F.broadcast(about))  # one row


def point_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soundings in coarse bins, by survey, and their mean over the bins that have any."""
    s = tables.soundings(spark, sf_dir)
    at = s.groupBy("cdi", F.least(F.floor(F.col("n") / 100), F.lit(9)).cast("int").alias("row"), F.least(F.floor(F.col("e") / 100), F.lit(9)).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return at.groupBy("cdi").agg(F.count(F.lit(1)).alias("bins"), F.round(F.avg("n"), 9).alias("density"), F.max("n").alias("most"))


def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with a fifth of their pixels or more, and the spread of their values about the mean."""
    p = tables.pixels(spark, sf_dir).select("cell", "cdi", "row", "col", "v")
    good = raster.coverage(p, TOTAL).where("share >= 0.2").select("cell", "cdi", "valid")
    d = raster.demeaned(p).groupBy("cell", "cdi").agg(F.round(F.min("v"), 9).alias("least"), F.round(F.max("v"), 9).alias("most"), F.round(F.stddev_pop("v"), 9).alias("sd"))
    return good.join(d, ["cell", "cdi"])


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All surveys of a cell in one raster, by mean and by maximum."""
    p = tables.pixels(spark, sf_dir)
    mean, most = raster.combine(p, "mean"), raster.combine(p, "max").withColumnRenamed("v", "most")
    return mean.join(most, ["cell", "row", "col"]).select("cell", "row", "col", F.round("v", 9).alias("mean"), F.round("most", 9).alias("most"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of five pixels: mean, maximum of what there is, and maximum of whole blocks only."""
    p = raster.combine(tables.pixels(spark, sf_dir), "mean")
    out = None
    for how in ("mean", "max", "whole_max"):
        b = raster.block_reduce(p, 5, how).withColumnRenamed("v", how)
        out = b if out is None else out.join(b, ["cell", "row", "col"])
    return out.select("cell", "row", "col", *(F.round(h, 9).alias(h) for h in ("mean", "max", "whole_max")))


def padded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four on the grid of all cells, where 50 isn't a multiple and the edge counts as 0."""
    one = raster.combine(tables.pixels(spark, sf_dir).withColumn("v", F.col("v") - 60), "mean", ())
    return raster.padded_max(one, 4, ROWS, COLS).withColumn("v", F.round("v", 9))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(tables.pixels(spark, sf_dir), "v", 0.0, 110.0, 50, ("cdi",))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles for scaling, and how far 60 lies above the median in deviations."""
    p = tables.pixels(spark, sf_dir).select("cdi", "v")
    found = quantiles.quantiles(p, "v", (0.01, 0.02, 0.5, 0.9, 0.98, 0.99), ("cdi",))
    found = quantiles.wide(found, ("cdi",), {0.01: "p1", 0.02: "p2", 0.5: "mid", 0.9: "p90", 0.98: "p98", 0.99: "p99"})
    both = found.join(p.groupBy("cdi").agg(F.stddev_pop("v").alias("sd")), "cdi")
    return both.select("cdi", *(F.round(f"p{q}", 9).alias(f"p{q}") for q in (1, 2, 90, 98, 99)), F.round((F.lit(60.0) - F.col("mid")) / F.col("sd"), 9).alias("sigmas"))


def gap_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single missing pixels get the mean of their neighbours."""
    p = tables.pixels(spark, sf_dir).select("cell", "cdi", "row", "col", "v")
    filled = raster.gaps_filled(raster.dense(p, ROWS, COLS))
    return filled.where("v IS NOT NULL").select("cell", "cdi", "row", "col", F.round("v", 9).alias("v"))


def tile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to tiles, flipped, and back."""
    p = tables.pixels(spark, sf_dir).select("cell", "cdi", "row", "col", "v")
    back = raster.to_pixels(raster.to_tiles(raster.flipped(p, ROWS), ROWS, COLS)).where("v IS NOT NULL")
    return back.groupBy("cell", "cdi").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("v") * (F.col("row") + 1)), 6).alias("by_row"), F.round(F.sum(F.col("v") * (F.col("col") + 1)), 6).alias("by_col"))


def first_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five surveys."""
    return tables.surveys(spark, sf_dir).orderBy("cdi").limit(5).select("cdi", "local_id", "rejected")


QUERIES = {
    f.__name__: f
    for f in (
        eligible_surveys, rasterised, raster_shift, bounds, survey_count_grid, survey_count_histogram, point_density, tile_coverage,
        combined, blocks, padded_blocks, value_histogram, percentiles, gap_filling, tile_round_trip, first_surveys,
    )
}

_MEAN = f"(SELECT cell, row, col, avg(v) AS v FROM {P} GROUP BY ALL)"
_GRID = f"(SELECT CAST(floor(n / 50) AS INT) AS row, CAST(floor(e / 50) AS INT) AS col, count(DISTINCT cdi) AS v FROM {S} WHERE n < 1000 AND e < 1000 GROUP BY ALL)"
ORACLES = {
    "eligible_surveys": f"""SELECT cdi, concat('000574_XYZ_', replace(replace(local_id, '/', '_'), 'v', 'V'), '.txt') AS file_name, CAST(substr(CAST(start_date AS VARCHAR), 1, 4) AS INT) AS year,
      CAST(date_diff('day', CAST(strptime(CAST(start_date AS VARCHAR), '%Y%m%d') AS DATE), CAST(strptime(CAST(end_date AS VARCHAR), '%Y%m%d') AS DATE)) AS BIGINT) AS days FROM {M} WHERE rejected = 0 AND density > 20""",
    "rasterised": f"SELECT cell, cdi, row, col, round(v, 9) AS v FROM {P}",
    "raster_shift": f"""WITH m AS (SELECT cell, cdi, shift, floor((1000.0 - n) / ((1000.0 + shift) / 50)) AS r, floor((e + shift) / 20) AS c FROM {S}, (SELECT unnest(range(11)) AS shift)
        WHERE e > -shift AND e < 1000 - shift AND n > -shift AND n < 1000),
      g AS (SELECT cell, cdi, shift, count(DISTINCT (r, c)) AS filled, count(*) AS points FROM m GROUP BY ALL),
      b AS (SELECT *, row_number() OVER (PARTITION BY cell, cdi ORDER BY CASE WHEN filled / points >= 0.8 THEN 0 ELSE 1 END, CASE WHEN filled / points >= 0.8 THEN shift ELSE -shift END) AS k FROM g)
      SELECT cell, cdi, CAST(shift AS INT) AS shift, filled, points FROM b WHERE k = 1""",
    "bounds": f"SELECT cdi, min(e) AS x0, max(e) AS x1, min(n) AS y0, max(n) AS y1, max(e) - min(e) AS width, median(e) AS mid_e, median(n) AS mid_n, count(*) AS n_points FROM {S} GROUP BY cdi",
    "survey_count_grid": f"SELECT * FROM {_GRID}",
    "survey_count_histogram": f"SELECT bin, n, least, most, mean FROM (SELECT CAST(least(floor(v / 0.5), 9) AS INT) AS bin, count(*) AS n FROM {_GRID} WHERE v BETWEEN 0 AND 5 GROUP BY ALL), (SELECT min(v) AS least, max(v) AS most, round(avg(v), 9) AS mean FROM {_GRID})",
    "point_density": f"SELECT cdi, count(*) AS bins, round(avg(n), 9) AS density, max(n) AS most FROM (SELECT cdi, least(floor(n / 100), 9) AS r, least(floor(e / 100), 9) AS c, count(*) AS n FROM {S} GROUP BY ALL) GROUP BY cdi",
    "tile_coverage": f"""WITH m AS (SELECT *, v - avg(v) OVER (PARTITION BY cell, cdi) AS d FROM {P}) SELECT cell, cdi, count(*) AS valid, round(min(d), 9) AS least, round(max(d), 9) AS most, round(stddev_pop(d), 9) AS sd FROM m GROUP BY cell, cdi HAVING count(*) >= {TOTAL // 5}""",
    "combined": f"SELECT cell, row, col, round(avg(v), 9) AS mean, round(max(v), 9) AS most FROM {P} GROUP BY ALL",
    "blocks": f"SELECT cell, row // 5 AS row, col // 5 AS col, round(avg(v), 9) AS mean, round(max(v), 9) AS max, CASE WHEN count(v) = 25 THEN round(max(v), 9) END AS whole_max FROM {_MEAN} GROUP BY cell, row // 5, col // 5",
    "padded_blocks": f"""SELECT row // 4 AS row, col // 4 AS col, round(CASE WHEN row // 4 = 12 OR col // 4 = 12 THEN greatest(max(v), 0) ELSE max(v) END, 9) AS v
      FROM (SELECT row, col, avg(v - 60) AS v FROM {P} GROUP BY ALL) GROUP BY row // 4, col // 4""",
    "value_histogram": f"SELECT cdi, CAST(least(floor(v / (CAST(110 AS DOUBLE) / 50)), 49) AS INT) AS bin, count(*) AS n FROM {P} WHERE v BETWEEN 0 AND 110 GROUP BY ALL",
    "percentiles": f"SELECT cdi, {', '.join(f'round(quantile_cont(v, {q / 100}), 9) AS p{q}' for q in (1, 2, 90, 98, 99))}, round((60 - median(v)) / stddev_pop(v), 9) AS sigmas FROM {P} GROUP BY cdi",
    "gap_filling": f"""WITH p AS (SELECT * FROM {P}), g AS (SELECT cell, cdi, r AS row, c AS col FROM (SELECT DISTINCT cell, cdi FROM p), (SELECT unnest(range(50)) AS r), (SELECT unnest(range(50)) AS c)),
      f AS (SELECT g.cell, g.cdi, g.row, g.col, avg(p.v) AS m, count(*) AS k FROM g JOIN p ON g.cell = p.cell AND g.cdi = p.cdi AND abs(g.row - p.row) + abs(g.col - p.col) = 1 AND g.row BETWEEN p.row - 1 AND p.row + 1 GROUP BY ALL)
      SELECT cell, cdi, row, col, round(v, 9) AS v FROM p UNION ALL SELECT cell, cdi, CAST(row AS INT), CAST(col AS INT), round(m, 9) FROM f ANTI JOIN p USING (cell, cdi, row, col) WHERE k = 4""",
    "tile_round_trip": f"SELECT cell, cdi, count(*) AS n, round(sum(v * (50 - row)), 6) AS by_row, round(sum(v * (col + 1)), 6) AS by_col FROM {P} GROUP BY cell, cdi",
    "first_surveys": f"SELECT cdi, local_id, rejected FROM {M} ORDER BY cdi LIMIT 5",
}
