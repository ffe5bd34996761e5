"""Queries on cells that polygons and routes meet, on gradients of smoothed tiles, and on rows to cut tiles along."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.operators import crossings, focal, vector

from . import focal_queries, map_queries
from .tables import COLS, ROWS

TILE = focal_queries.TILE
POLYGON_CELL, ROUTE_CELL, SIGMA = 100.0, 10.0, 1.5


def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each polygon meets."""
    return crossings.polygon_cells(vector.edges(map_queries._rings(spark, sf_dir)), POLYGON_CELL)


def cells_along_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each route meets, by the distance along it."""
    w = map_queries._walks(spark, sf_dir)
    nxt = Window.partitionBy("run_id").orderBy("step")
    ends = {"ax": F.col("col"), "ay": F.col("row"), "bx": F.lead("col").over(nxt), "by": F.lead("row").over(nxt)}
    s = w.select(F.col("run_id").alias("id"), F.col("step").alias("seq"), *((v + 0.5).alias(k) for k, v in ends.items())).where("bx IS NOT NULL")
    return crossings.cells_along(s, ROUTE_CELL).withColumnRenamed("id", "run_id")


def _smooth_gradient(p: DataFrame, times: int = 1) -> DataFrame:
    """Gradient of smoothed tiles, or of those gradients smoothed again."""

    def f(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = focal.slopes(focal.weighted(a, SIGMA))
        return a

    return focal.on_rasters(p, f, ROWS, COLS, TILE)


def smoothed_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of smoothed tiles."""
    return focal_queries._by_row(_smooth_gradient(focal_queries._dense(spark, sf_dir)))


def gradient_of_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the smoothed gradient of smoothed tiles."""
    return focal_queries._by_row(_smooth_gradient(focal_queries._dense(spark, sf_dir), 2))


def cross_section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each tile whose pixels without a value lie farthest from both edges, the first of equal ones; the middle row of a
    tile without such pixels."""
    d = focal_queries._dense(spark, sf_dir)
    gap = F.when(F.col("v").isNull(), F.col("col"))
    margin = d.groupBy(*TILE, "row").agg(F.least(F.min(gap), COLS - 1 - F.max(gap)).alias("margin"))
    best = F.max(F.when(F.col("margin").isNotNull(), F.struct("margin", (-F.col("row")).alias("up")))).alias("b")
    return margin.groupBy(*TILE).agg(best).select(*TILE, F.coalesce(-F.col("b.up"), F.lit(ROWS // 2)).alias("row"), F.col("b.margin").alias("margin"))


QUERIES = {f.__name__: f for f in (polygon_cells, cells_along_routes, smoothed_gradient, gradient_of_gradient, cross_section_rows)}


def _clip(size: int, a: tuple[str, str], b: tuple[str, str]) -> str:
    """Whether a segment touches the cell (r, c) of `size`."""
    lows, highs, ok = ["0"], ["1"], []
    for p, q, k in ((a[0], b[0], "c"), (a[1], b[1], "r")):
        lo, hi, d = f"({k} * {size})", f"(({k} + 1) * {size})", f"({q} - {p})"
        lows.append(f"CASE WHEN {d} = 0 THEN 0 ELSE least(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) END")
        highs.append(f"CASE WHEN {d} = 0 THEN 1 ELSE greatest(({lo} - {p}) / {d}, ({hi} - {p}) / {d}) END")
        ok.append(f"({d} <> 0 OR {p} BETWEEN {lo} AND {hi})")
    return f"{' AND '.join(ok)} AND greatest({', '.join(lows)}) <= least({', '.join(highs)})"


def _grid(first: int, last: int) -> str:
    return f"(SELECT unnest(range({first}, {last + 1})) AS r), (SELECT unnest(range({first}, {last + 1})) AS c)"


def _smooth(q: str) -> str:
    mirrored = focal_queries._mirror(f"(SELECT * FROM {q} WHERE v IS NOT NULL)", 6)
    rows = f"(SELECT cell, cdi, row + d AS row, col, sum(v * w) AS a, sum(w) AS b FROM {mirrored}, {focal_queries._GAUSS} GROUP BY ALL)"
    cols = f"(SELECT cell, cdi, row, col + d AS col, sum(a * w) / sum(b * w) AS v FROM {rows}, {focal_queries._GAUSS} WHERE row BETWEEN 0 AND 49 GROUP BY cell, cdi, row, col + d)"
    return f"(SELECT g.cell, g.cdi, g.row, g.col, s.v FROM {focal_queries._DENSE} g LEFT JOIN {cols} s ON g.cell = s.cell AND g.cdi = s.cdi AND g.row = s.row AND g.col = s.col)"


def _gradient(q: str) -> str:
    return f"(SELECT cell, cdi, row, col, sqrt(a * a + b * b) AS v FROM (SELECT cell, cdi, row, col, {focal_queries._slope('row')} AS a, {focal_queries._slope('col')} AS b FROM {_smooth(q)}))"


ORACLES = {
    "polygon_cells": f"""WITH e AS {map_queries._EDGES}, g AS (SELECT * FROM {_grid(-1, 10)}),
      t AS (SELECT DISTINCT id, r, c FROM e, g WHERE {_clip(100, ('x1', 'y1'), ('x2', 'y2'))}),
      i AS (SELECT id, r, c FROM e, g WHERE (y1 > r * 100 + 50) <> (y2 > r * 100 + 50) AND c * 100 + 50 < (x2 - x1) * (r * 100 + 50 - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
      SELECT id, CAST(r AS INT) AS row, CAST(c AS INT) AS col FROM (SELECT * FROM t UNION SELECT * FROM i)""",
    "cells_along_routes": f"""WITH p AS (SELECT run_id, step, col + CAST(0.5 AS DOUBLE) AS ax, row + CAST(0.5 AS DOUBLE) AS ay, lead(col) OVER w + CAST(0.5 AS DOUBLE) AS bx, lead(row) OVER w + CAST(0.5 AS DOUBLE) AS by_
        FROM {map_queries._WALKS} WINDOW w AS (PARTITION BY run_id ORDER BY step)),
      l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS k FROM p WHERE bx IS NOT NULL),
      s AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ FROM l),
      c AS (SELECT DISTINCT run_id, r, c FROM l, {_grid(-1, 5)} WHERE {_clip(10, ('ax', 'ay'), ('bx', 'by_'))}),
      t AS (SELECT *, c * 10 + CAST(5 AS DOUBLE) AS mx, r * 10 + CAST(5 AS DOUBLE) AS my FROM c JOIN s USING (run_id)),
      u AS (SELECT *, CASE WHEN k > 0 THEN least(greatest(((mx - ax) * (bx - ax) + (my - ay) * (by_ - ay)) / (k * k), 0), 1) ELSE 0 END AS t FROM t),
      b AS (SELECT run_id, r, c, round(begin_ + t * k, 6) AS chainage FROM u QUALIFY row_number() OVER (PARTITION BY run_id, r, c
        ORDER BY round((mx - ax - t * (bx - ax)) * (mx - ax - t * (bx - ax)) + (my - ay - t * (by_ - ay)) * (my - ay - t * (by_ - ay)), 9), step) = 1)
      SELECT run_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, chainage, CAST(row_number() OVER (PARTITION BY run_id ORDER BY chainage, r, c) AS INT) AS nth FROM b""",
    "smoothed_gradient": focal_queries._digest(f"SELECT * FROM {_gradient(focal_queries._DENSE)}"),
    "gradient_of_gradient": focal_queries._digest(f"SELECT * FROM {_gradient(_gradient(focal_queries._DENSE))}"),
    "cross_section_rows": f"""WITH m AS (SELECT cell, cdi, row, least(min(col), 49 - max(col)) AS margin FROM {focal_queries._DENSE} WHERE v IS NULL GROUP BY ALL),
      b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cell, cdi ORDER BY margin DESC, row) = 1)
      SELECT t.cell, t.cdi, CAST(coalesce(b.row, 25) AS INT) AS row, CAST(margin AS INT) AS margin FROM (SELECT DISTINCT cell, cdi FROM {map_queries.P}) t LEFT JOIN b ON t.cell = b.cell AND t.cdi = b.cdi""",
}
