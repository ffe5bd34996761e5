"""Survey tables derived from the given ones, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators import raster

ORDER = ("k1", "k2", "k3", "k4")
SIZE, ROWS, COLS = 20.0, 50, 50

SOUNDINGS = """SELECT CAST(floor(l_orderkey / 1250) AS INT) AS cell, CAST(l_suppkey % 4 AS BIGINT) AS cdi, CAST(2000 + 3 * (l_suppkey % 4) AS INT) AS year,
  CAST((l_partkey * 11 + l_linenumber * 5 + l_suppkey * 3) % 5000 AS DOUBLE) / 5 AS e,
  CAST((l_orderkey * 7 + l_linenumber * 13) % 5000 AS DOUBLE) / 5 AS n,
  l_extendedprice / 1000 AS depth, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4 FROM {lineitem}"""
PIXELS = f"""SELECT cell, cdi, year, row, col, v FROM (SELECT *, row_number() OVER (PARTITION BY cell, cdi, row, col ORDER BY k1 DESC, k2 DESC, k3 DESC, k4 DESC, v DESC) AS rn
  FROM (SELECT cell, cdi, year, k1, k2, k3, k4, depth AS v, CAST(floor((1000 - n) / 20) AS INT) AS row, CAST(floor(e / 20) AS INT) AS col
        FROM ({SOUNDINGS}) WHERE e > 0 AND e < 1000 AND n > 0 AND n < 1000)) WHERE rn = 1"""
SURVEYS = """SELECT s_suppkey AS cdi, concat(s_name, '/v', CAST(s_nationkey AS VARCHAR(9))) AS local_id, s_name AS data_set,
  CAST(19900101 + 10000 * (s_suppkey % 30) + 100 * (s_suppkey % 12) + s_suppkey % 28 AS INT) AS start_date,
  CAST(19910101 + 10000 * (s_suppkey % 30) + 100 * ((s_suppkey + 5) % 12) + s_suppkey % 28 AS INT) AS end_date,
  CAST(CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS INT) AS rejected, s_acctbal / 100 AS density FROM {supplier}"""


def text(sql: str) -> str:
    """The same for DuckDB, which knows the tables by name."""
    return sql.format(lineitem="lineitem", supplier="supplier")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SOUNDINGS, lineitem=read(spark, sf_dir, "lineitem"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, cdi, year, row, col, v: cells of 50 x 50 pixels, as many as there are ranges of 1250 orders, and four surveys. A cell's
    soundings are gathered, so that nothing by cell and others is shuffled after that."""
    return raster.rasterise(soundings(spark, sf_dir), ORDER, SIZE, ROWS, COLS, keys=("cell", "cdi", "year"), by=("cell",))


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SURVEYS, supplier=read(spark, sf_dir, "supplier"))
