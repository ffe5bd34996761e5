"""Queries over records: looked up costs and metadata, pairs by date, positions that are valid, and tables written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import coords
from tidegrid.operators import costmap, raster
from tidegrid.sources import readers

from . import coverage_queries, map_queries, mosaic_queries, tables

S, P = (tables.text(f"({q})") for q in (tables.SOUNDINGS, tables.PIXELS))
#: Degrees of a bin, and of the margin around all positions.
BIN, MARGIN = 0.25, 0.1
SITES = """SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE 51 + CAST(c_custkey * 7919 % 5000 AS DOUBLE) / 1000 END AS lat,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(c_custkey * 104729 % 9000 AS DOUBLE) / 1000 END AS lon FROM {customer}"""


def site_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's cost at each site that lies on it, NULL without data."""
    s = map_queries._sites(spark, sf_dir)
    row, col = coords.grid_index(F.col("e"), F.col("n"))
    return costmap.cost_at(s.select("id", row.alias("row"), col.alias("col")), mosaic_queries._map(spark, sf_dir)).withColumn("v", F.round("v", 9))


def tile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with the name and the dates of their survey, where it has metadata."""
    t = tables.pixels(spark, sf_dir).groupBy("cell", "cdi").agg(F.count("v").alias("n"))
    m = tables.surveys(spark, sf_dir).select("cdi", "local_id", "start_date", "rejected")
    return t.join(m, "cdi", "left").select("cell", "cdi", "n", "local_id", "start_date", "rejected")


def date_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of a nation's surveys, the later start first; starts are compared as text, which yyyymmdd allows."""
    s = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cdi"), F.col("s_nationkey").alias("area"))
    s = s.join(tables.surveys(spark, sf_dir).select("cdi", F.col("start_date").cast("string").alias("start")), "cdi")
    new, old = (s.select("area", F.col("cdi").alias(f"id_{x}"), F.col("start").alias(f"start_{x}")) for x in ("new", "old"))
    return new.join(old, "area").where("start_new > start_old")


def valid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with both coordinates, counted in bins."""
    return raster.position_grid(spark.sql(SITES, customer=tables.read(spark, sf_dir, "customer")), BIN, MARGIN)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soundings with a derived column written as CSV and read again: number, sum and largest of each tile."""
    path = coverage_queries._folder(spark)
    s = tables.soundings(spark, sf_dir).select("cell", "cdi", "e", "n", "depth", F.round(F.col("depth") * 100).cast("long").alias("cm"))
    readers.write_csv(s, path)
    back = spark.read.csv(path, header=True, schema="cell int, cdi long, e double, n double, depth double, cm long")
    return back.groupBy("cell", "cdi").agg(F.count(F.lit(1)).alias("n"), F.sum("cm").alias("cm"), F.round(F.sum("depth"), 6).alias("depth"), F.max("e").alias("e"))


QUERIES = {f.__name__: f for f in (site_costs, tile_metadata, date_pairs, valid_positions, csv_round_trip)}

_M = tables.text(f"({tables.SURVEYS})")
ORACLES = {
    "site_costs": f"""WITH {mosaic_queries._MAP}, s AS (SELECT id, CAST(least(floor((n - 5910512) / 100), 349) AS INT) AS row, CAST(least(floor((e - 555652) / 100), 799) AS INT) AS col FROM {map_queries._SITES}
      WHERE e BETWEEN 555652 AND 635652 AND n BETWEEN 5910512 AND 5945512) SELECT id, row, col, round(v, 9) AS v FROM s JOIN m USING (row, col)""",
    "tile_metadata": f"SELECT cell, t.cdi, n, local_id, start_date, rejected FROM (SELECT cell, cdi, count(v) AS n FROM {P} GROUP BY ALL) t LEFT JOIN {_M} m ON t.cdi = m.cdi",
    "date_pairs": f"""WITH s AS (SELECT s_suppkey AS cdi, s_nationkey AS area, CAST(start_date AS VARCHAR) AS start FROM supplier JOIN {_M} m ON s_suppkey = m.cdi)
      SELECT a.area, a.cdi AS id_new, a.start AS start_new, b.cdi AS id_old, b.start AS start_old FROM s a JOIN s b ON a.area = b.area AND a.start > b.start""",
    "valid_positions": f"""WITH s AS (SELECT * FROM ({SITES.format(customer='customer')}) WHERE lat IS NOT NULL AND lon IS NOT NULL), o AS (SELECT min(lat) - CAST({MARGIN} AS DOUBLE) AS lat0, min(lon) - CAST({MARGIN} AS DOUBLE) AS lon0 FROM s)
      SELECT CAST(floor((lat - lat0) / CAST({BIN} AS DOUBLE)) AS INT) AS row, CAST(floor((lon - lon0) / CAST({BIN} AS DOUBLE)) AS INT) AS col, count(*) AS n FROM s, o GROUP BY ALL""",
    "csv_round_trip": f"SELECT cell, cdi, count(*) AS n, CAST(sum(CAST(round(depth * 100) AS BIGINT)) AS BIGINT) AS cm, round(sum(depth), 6) AS depth, max(e) AS e FROM {S} GROUP BY ALL",
}
