"""Queries on the cells that surveys cover, over tables stored by cell."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import coverage, vector
from tidegrid.operators.labels import saved

from . import tables

#: Cells of the map: metres of a side, cells in a row.
SIZE, ACROSS = 1000.0, 16
# Surveys of this kind follow each other along the map: a survey is 3000 orders, a cell 1250.
LINES = f"""SELECT CAST(floor(k1 / 3000) AS BIGINT) AS survey, cell, cell % {ACROSS} * {SIZE} + e AS x, floor(cell / {ACROSS}) * {SIZE} + n AS y, depth FROM ({tables.SOUNDINGS})"""


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one of a session with a local master."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='tidegrid-')}/by-cell-{uuid.uuid4().hex}"


def _dense_surveys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All soundings with their survey, and the hulls of the surveys whose soundings lie as dense in them as those of the mean survey do."""
    points = spark.sql(LINES, lineitem=tables.read(spark, sf_dir, "lineitem"))
    hulls = saved(vector.hull(points, "survey"))
    area = vector.areas(hulls.withColumnRenamed("survey", "id")).withColumnRenamed("id", "survey")
    density = points.groupBy("survey").count().join(area, "survey").select("survey", (F.col("count") / F.col("area")).alias("density"))
    mean = density.agg(F.avg("density").alias("mean"))
    some = density.crossJoin(F.broadcast(mean)).where("density >= mean").select("survey")  # one row
    return points, hulls.join(some, "survey")


def hull_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the denser surveys and each cell that their hulls meet: soundings of the survey there, and of all surveys, with their mean
    depth. Only those cells are read from the soundings stored by cell."""
    points, hulls = _dense_surveys(spark, sf_dir)
    path = _folder(spark)
    coverage.write_by_cell(points, path)
    cells = coverage.hull_cells(hulls, "survey", SIZE, ACROSS)
    found = coverage.of_cells(spark, path, cells.withColumnRenamed("survey", "of"))
    own = F.col("survey") == F.col("of")
    return found.groupBy(F.col("of").alias("survey"), "cell").agg(F.count(F.when(own, 1)).alias("own"), F.count(F.lit(1)).alias("n"), F.round(F.avg("depth"), 7).alias("depth"))


QUERIES = {"hull_coverage": hull_coverage}
ORACLES = {
    # hulls by gift wrapping: from the lowest point on, the next vertex is the one that everything else lies to the left of
    "hull_coverage": f"""WITH RECURSIVE p AS ({tables.text(LINES)}), d AS (SELECT DISTINCT survey, x, y FROM p),
      s AS (SELECT survey, min(y) AS y FROM d GROUP BY survey), t AS (SELECT d.survey, d.y, min(x) AS x FROM d JOIN s ON d.survey = s.survey AND d.y = s.y GROUP BY ALL),
      h AS (SELECT survey, 0 AS n, x, y, x AS fx, y AS fy, CAST(0 AS DOUBLE) AS a FROM t
        UNION ALL SELECT h.survey, h.n + 1, b.x, b.y, h.fx, h.fy, b.a FROM (SELECT survey, n, fx, fy, arg_min({{'x': px, 'y': py, 'a': na}}, (round(turn, 11), -far)) AS b FROM
          (SELECT h.*, d.x AS px, d.y AS py, atan2(d.y - h.y, d.x - h.x) AS na, (d.x - h.x) ** 2 + (d.y - h.y) ** 2 AS far,
             atan2(d.y - h.y, d.x - h.x) - h.a + CASE WHEN atan2(d.y - h.y, d.x - h.x) - h.a < -1e-11 THEN 2 * pi() ELSE 0 END AS turn
           FROM h JOIN d ON h.survey = d.survey AND (d.x <> h.x OR d.y <> h.y) WHERE h.n < 500 AND (h.n = 0 OR h.x <> h.fx OR h.y <> h.fy)) GROUP BY survey, n, fx, fy) h),
      e AS (SELECT survey, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM h WINDOW w AS (PARTITION BY survey ORDER BY n)),
      g AS (SELECT survey, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM e WHERE x2 IS NOT NULL GROUP BY survey),
      q AS (SELECT survey, count(*) / area AS density FROM p JOIN g USING (survey) GROUP BY survey, area),
      o AS (SELECT survey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d WHERE survey IN (SELECT survey FROM q WHERE density >= (SELECT avg(density) FROM q)) GROUP BY survey),
      c AS (SELECT survey, i AS r, j AS c FROM o, (SELECT unnest(range(CAST((SELECT ceil(max(y) / {SIZE}) FROM d) AS INT) + 1)) AS i), (SELECT unnest(range({ACROSS})) AS j)
        WHERE j * {SIZE} <= x1 AND (j + 1) * {SIZE} >= x0 AND i * {SIZE} <= y1 AND (i + 1) * {SIZE} >= y0),
      m AS (SELECT survey, r * {ACROSS} + c AS cell FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.survey = c.survey AND e.x2 IS NOT NULL
        AND (x2 - x1) * (r * {SIZE} - y1) - (y2 - y1) * (c * {SIZE} - x1) < 0 AND (x2 - x1) * ((r + 1) * {SIZE} - y1) - (y2 - y1) * (c * {SIZE} - x1) < 0
        AND (x2 - x1) * (r * {SIZE} - y1) - (y2 - y1) * ((c + 1) * {SIZE} - x1) < 0 AND (x2 - x1) * ((r + 1) * {SIZE} - y1) - (y2 - y1) * ((c + 1) * {SIZE} - x1) < 0))
      SELECT m.survey, CAST(m.cell AS INT) AS cell, count(CASE WHEN p.survey = m.survey THEN 1 END) AS own, count(*) AS n, round(avg(depth), 7) AS depth FROM m JOIN p ON m.cell = p.cell GROUP BY m.survey, m.cell""",
}
