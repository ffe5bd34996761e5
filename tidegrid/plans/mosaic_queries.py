"""Queries over the whole map: all cells side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import costmap, mosaic, raster
from tidegrid.operators.labels import saved

from . import tables
from .tables import COLS, ROWS

P = tables.text(f"({tables.PIXELS})")
HIGH, GAP = 55.0, 2


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v: the mean of the surveys at every pixel of the cells, NULL without one; row 0 south."""
    mean = raster.combine(tables.pixels(spark, sf_dir), "mean")
    return costmap.placed(raster.flipped(raster.dense(mean, ROWS, COLS, ("cell",)), ROWS))


def map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of deep pixels over all cells, and their sizes."""
    found = saved(mosaic.regions(_map(spark, sf_dir).where(F.col("v") > HIGH), 50))
    return found.join(mosaic.region_sizes(found).hint("merge"), "region").select("row", "col", "region", "size")


def map_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pixel with a value for each that has none, wherever on the map it lies."""
    found = mosaic.nearest_values(_map(spark, sf_dir)).where("v IS NULL")
    return found.select("row", "col", "d2", "near_row", "near_col", F.round("near", 9).alias("near"))


def map_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of up to two pixels filled from the nearest, larger ones left."""
    return mosaic.filled(_map(spark, sf_dir), GAP, 50).withColumn("v", F.round("v", 9))


QUERIES = {f.__name__: f for f in (map_regions, map_distances, map_filled)}

_MAP = f"""m AS (SELECT CAST(49 - r + c.cell // 16 * 50 AS INT) AS row, CAST(k + c.cell % 16 * 50 AS INT) AS col, avg(v) AS v FROM (SELECT DISTINCT cell FROM {P}) c, (SELECT unnest(range({ROWS})) AS r), (SELECT unnest(range({COLS})) AS k)
  LEFT JOIN {P} p ON p.cell = c.cell AND p.row = r AND p.col = k GROUP BY ALL)"""


def _regions(where: str) -> str:
    """Pixels that meet the condition, their links, and what each reaches."""
    return f"""x AS (SELECT row, col, CAST(row AS BIGINT) * 4294967296 + col AS id FROM m WHERE {where}),
      l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN (SELECT unnest([1, -1, 0, 0]) AS dr, unnest([0, 0, 1, -1]) AS dc) s ON true JOIN x b ON b.row = a.row + s.dr AND b.col = a.col + s.dc),
      t AS (SELECT id, id AS other FROM x UNION SELECT t.id, l.b FROM t JOIN l ON t.other = l.a),
      g AS (SELECT id, min(other) AS region, count(*) AS size FROM t GROUP BY id)"""


_NEAREST = "(SELECT a.row, a.col, arg_min(b, ((a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.row, b.col)) AS b FROM m a, m b WHERE a.v IS NULL AND b.v IS NOT NULL GROUP BY a.row, a.col)"
ORACLES = {
    "map_regions": f"WITH RECURSIVE {_MAP}, {_regions(f'v > {HIGH}')} SELECT row, col, region, size FROM x JOIN g ON x.id = g.id",
    "map_distances": f"""WITH {_MAP} SELECT row, col, CAST((row - b.row) ** 2 + (col - b.col) ** 2 AS BIGINT) AS d2, CAST(b.row AS BIGINT) AS near_row, CAST(b.col AS BIGINT) AS near_col, round(b.v, 9) AS near FROM {_NEAREST}""",
    "map_filled": f"""WITH RECURSIVE {_MAP}, {_regions('v IS NULL')}, n AS {_NEAREST}
      SELECT m.row, m.col, round(CASE WHEN g.size <= {GAP} THEN n.b.v ELSE m.v END, 9) AS v FROM m LEFT JOIN x ON m.row = x.row AND m.col = x.col LEFT JOIN g ON x.id = g.id LEFT JOIN n ON m.row = n.row AND m.col = n.col""",
}
