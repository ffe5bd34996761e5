"""Bedform labels: features, clusters of bounded size, and the clean-up of label rasters."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from . import focal
from .kernels import components4

TILE = ("cell", "cdi")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; one of our own only where none is set, and only with a local master."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidegrid-"))
    return df.checkpoint()


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation; one row of sums is joined to all."""
    about = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(about))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}).drop(*about.columns)


def two_means(df: DataFrame, columns: list[str], order: list[str], least: float = 0.05, rounds: int = 25, tolerance: float = 1e-3) -> DataFrame:
    """`df` with label 0 or 1: two clusters, none with less than `least` of the rows; 1 is the smaller one.

    The cheapest assignment under that bound cuts the rows, sorted by the difference of their squared distances to the
    two centres, where the difference changes sign, or at the bound. The cut's rank is found by counting value ranges,
    not by a global sort. Rows without a value in a column aren't labelled. Start: means of the halves below and
    above the mean of the first column.
    """
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    half = F.when(F.col(columns[0]) > rows.agg(F.avg(columns[0])).first()[0], 1).otherwise(0)
    means = lambda d, by: [r[1:] for r in sorted(d.groupBy(by.alias("_k")).agg(*(F.avg(c) for c in columns)).collect())]
    centres, n = means(rows, half), rows.count()
    if len(centres) < 2:
        return rows.withColumn("label", F.lit(0))
    floor_ = -(-int(n * least * 1000) // 1000)
    for _ in range(rounds):
        gap = sum((F.pow(F.col(c) - a, 2) - F.pow(F.col(c) - b, 2) for c, a, b in zip(columns, *centres)), F.lit(0.0))
        scored = rows.withColumn("_gap", gap)  # positive: nearer to the second centre
        upper = scored.where("_gap > 0").count()
        want = min(max(upper, floor_), n - floor_)
        label = F.col("_gap") > 0 if want == upper else _among_largest(scored, "_gap", order, want)
        scored = scored.withColumn("label", label.cast("int"))
        new = means(scored, F.col("label"))
        moved = max(abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if moved < tolerance:
            break
    small = want * 2 <= n
    return scored.withColumn("label", F.col("label") if small else 1 - F.col("label")).drop("_gap")


def plain_clusters(df: DataFrame, columns: list[str], seed: int = 1) -> DataFrame:
    """`df` with cluster (0 or 1) by plain k-means, 0 having the smaller centre in the first column; rows with a missing feature go."""
    given = saved(df.dropna(subset=columns))
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), KMeans(k=2, seed=seed, featuresCol="_x", predictionCol="cluster")]).fit(given)
    first = [c[0] for c in model.stages[-1].clusterCenters()]
    swap = len(first) == 2 and first[1] < first[0]
    return model.transform(given).drop("_x").withColumn("cluster", 1 - F.col("cluster") if swap else F.col("cluster"))


def _among_largest(df: DataFrame, v: str, order: list[str], k: int):
    """Condition for the k rows with the largest v, ties by `order`, by narrowing the range that holds the k-th."""
    above, low, high = 0, *df.agg(F.min(v), F.max(v)).first()
    while low < high:
        step = (high - low) / 1024
        at = F.least(F.floor((F.col(v) - low) / step), F.lit(1023))
        got = df.where(F.col(v).between(low, high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
        for r in sorted(got, key=lambda r: -r.b):
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.lo, r.hi
    tied = [tuple(r) for r in df.where(F.col(v) == low).orderBy(*order).limit(k - above).select(*order).tail(1)]
    key = F.struct(*order) <= F.struct(*map(F.lit, tied[0])) if tied else F.lit(False)
    return (F.col(v) > low) | ((F.col(v) == low) & key)


def _closed(a: np.ndarray, there: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """A mask dilated, and that eroded, `times` with a 3 x 3 square; beyond the edge is 1 for both."""
    size = 2 * times + 1
    wide = focal._extreme(a, there, size, "max")
    shut = np.ones(a.shape)
    inner = (slice(times, a.shape[0] - times), slice(times, a.shape[1] - times))
    shut[inner] = wide[inner]
    return wide, focal._extreme(shut, there, size, "min")


def closed(mask: DataFrame, times: int, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Dense masks (v 0 or 1) dilated and then eroded `times` with a 3 x 3 square; beyond the edge is 1 for both, so gaps
    between a region and the edge close. Repeats of a square are one larger square."""
    out = focal._of_rasters(mask, lambda a, there: {"v": _closed(a, there, times)[1]}, {"v": "double"}, rows, cols, keys)
    return out.withColumn("v", F.col("v").cast("int"))


def closings(mask: DataFrame, times: tuple[int, ...], rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, times, dilated, after: pixels of each mask once dilated and once closed, for each number of times, in one pass over a tile."""
    f = lambda a, there: {f"{n}{t}": x for t in times for n, x in zip("da", _closed(a, there, t))}
    each = focal._of_rasters(mask, f, {f"{n}{t}": "double" for t in times for n in "da"}, rows, cols, keys)
    sums = each.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in each.columns if c not in (*keys, "row", "col")))
    rows_ = F.array(*(F.struct(F.lit(t).alias("times"), F.col(f"d{t}").alias("dilated"), F.col(f"a{t}").alias("after")) for t in times))
    return sums.select(*keys, F.inline(rows_))


def regions(cells: DataFrame, keys: tuple[str, ...] = TILE) -> DataFrame:
    """`cells` (keys, row, col) with region: the first pixel, row * 65536 + col, of its 4-connected region.

    A tile's cells are one group: regions end with their tile, and a tile has a bounded number of pixels.
    """
    names = [*keys, "row", "col"]

    def labelled(t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        mask = np.zeros((row.max() - row.min() + 1, col.max() - col.min() + 1), bool)
        y, x = row - row.min(), col - col.min()
        mask[y, x] = True
        first = components4(mask)[y, x]
        region = (first // mask.shape[1] + row.min()) * 65536 + first % mask.shape[1] + col.min()
        return t.select(names).append_column("region", pa.array(region))

    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", region long"
    return cells.select(*names).groupBy(*keys).applyInArrow(labelled, schema)


def without_small(cells: DataFrame, least: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """The cells of regions of `least` pixels or more."""
    r = regions(cells, keys)
    big = r.groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return r.join(big, [*keys, "region"])


def filled_holes(mask: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Dense masks (v 0 or 1) whose 4-connected regions of 0 that don't touch the tile's edge become 1."""
    r = regions(mask.where("v = 0"), keys)
    edge = F.col("row").isin(0, rows - 1) | F.col("col").isin(0, cols - 1)
    open_ = r.where(edge).select(*keys, "region").distinct()
    holes = r.join(open_, [*keys, "region"], "left_anti").select(*keys, "row", "col", F.lit(1).alias("_h"))
    return mask.join(holes, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("_h", "v").alias("v"))


def cleaned(labels: DataFrame, rows: int, cols: int, sigma: float = 20.0, threshold: float = 0.35, closings: int = 2, least: int = 200, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Dense labels (v 0, 1 or NULL) smoothed, cut, closed, holes filled, without small regions: 1, 0, and -1 for no data."""
    s = focal.gaussian(labels, sigma, rows, cols, True, keys).withColumnRenamed("v", "s")
    m = saved(labels.join(s, [*keys, "row", "col"]).withColumn("ok", F.col("v").isNotNull()))
    cut = m.select(*keys, "row", "col", F.coalesce((F.col("ok") & (F.col("s") > threshold)).cast("int"), F.lit(0)).alias("v"))
    shut = saved(closed(cut, closings, rows, cols, keys))
    shut = filled_holes(shut, rows, cols, keys)
    kept = without_small(shut.where("v = 1"), least, keys).select(*keys, "row", "col", F.lit(1).alias("k"))
    out = m.select(*keys, "row", "col", "ok").join(kept, [*keys, "row", "col"], "left")
    return out.select(*keys, "row", "col", F.when(~F.col("ok"), -1).otherwise(F.coalesce("k", F.lit(0))).alias("v"))
