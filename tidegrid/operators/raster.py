"""Soundings to pixels, and pixels of one grid to those of another."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import on_tiles

TILE = ("cell", "cdi")


def in_box(x0: float, y0: float, x1: float, y1: float, closed: bool = False) -> Column:
    e, n = F.col("e"), F.col("n")
    return e.between(x0, x1) & n.between(y0, y1) if closed else (e > x0) & (e < x1) & (n > y0) & (n < y1)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt to all shuffle partitions by keys: aggregates and windows by these and others find their rows there, without a shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def rasterise(points: DataFrame, order: Iterable[str], size: float, rows: int, cols: int, x0: float = 0.0, y0: float = 0.0, keys: tuple[str, ...] = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, row (0 north), col, v: the depth of the last sounding, by `order`, strictly inside each pixel's box.

    One aggregation by pixel: partial maxima are taken before the shuffle. With `by`, some of the keys, soundings are gathered by these
    instead, and the pixels stay there.
    """
    top = y0 + rows * size
    at = points.where(in_box(x0, y0, x0 + cols * size, top))
    at = at.select(*keys, "depth", *order, F.floor((F.lit(top) - F.col("n")) / size).cast("int").alias("row"), F.floor((F.col("e") - x0) / size).cast("int").alias("col"))
    at = gathered(at, *by) if by else at
    return at.groupBy(*keys, "row", "col").agg(F.max_by("depth", F.struct(*order, "depth")).alias("v"))


def shift_search(points: DataFrame, size: float, rows: int, cols: int, least: float = 0.8, most: int = 10, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, shift, filled, points: the first shift of the box to west and south at which filled pixels / points
    reaches `least`, else the last one. The box moves by whole metres, its top stays, so rows get taller. Soundings are gathered by
    tile once; what the shifts make of them stays there."""
    points = gathered(points.select(*keys, "e", "n"), *keys)
    c = F.col("shift")
    x0, height = -c.cast("double"), (F.lit(rows * size) + 0.0)
    moved = points.select(*keys, "e", "n", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("shift"))
    dy, dx = (height + c) / rows, F.lit(float(size))
    moved = moved.where((F.col("e") > x0) & (F.col("e") < x0 + cols * size) & (F.col("n") > -c) & (F.col("n") < height))
    moved = moved.withColumns({"row": F.floor((height - F.col("n")) / dy), "col": F.floor((F.col("e") - x0) / dx)})
    each = moved.groupBy(*keys, "shift", "row", "col").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "shift")
    each = each.agg(F.count(F.lit(1)).alias("filled"), F.sum("n").alias("points"))
    good = F.col("filled") / F.col("points") >= least
    best = F.coalesce(F.min(F.when(good, F.struct("shift", "filled", "points"))), F.max(F.struct("shift", "filled", "points")))
    return each.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def combine(pixels: DataFrame, how: str, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """All surveys of a cell in one raster: `mean` or `max` of the values there are."""
    f = {"mean": F.avg, "max": F.max}[how]
    return pixels.groupBy(*keys, "row", "col").agg(f("v").alias("v"))


def block_reduce(pixels: DataFrame, k: int, how: str, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Blocks of k x k pixels: `mean`, `max`, `any`, or `whole_max`, which is NULL where a pixel has no value."""
    v = F.col("v")
    f = {"mean": F.avg(v), "max": F.max(v), "any": F.bool_or(v != 0), "whole_max": F.when(F.count(v) == k * k, F.max(v))}[how]
    return pixels.groupBy(*keys, F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(f.alias("v"))


def padded_max(pixels: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """Maximum of k x k blocks of one grid, whose missing edge pixels count as 0."""
    edge_r, edge_c = -(-rows // k) - 1 if rows % k else -1, -(-cols // k) - 1 if cols % k else -1
    out = block_reduce(pixels, k, "max", ())
    edge = (F.col("row") == edge_r) | (F.col("col") == edge_c)
    return out.withColumn("v", F.when(edge, F.greatest("v", F.lit(0.0))).otherwise(F.col("v")))


def coverage(pixels: DataFrame, total: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.count("v").alias("valid"), (F.count("v") / total).alias("share"))


def demeaned(pixels: DataFrame, keys: tuple[str, ...] = TILE) -> DataFrame:
    mean = pixels.groupBy(*keys).agg(F.avg("v").alias("_mean"))  # a row a tile, joined back by Spark's own choice
    return pixels.join(mean, list(keys)).withColumn("v", F.col("v") - F.col("_mean")).drop("_mean")


def dense(pixels: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Every pixel of the tiles that have any; NULL where there is no value. `pixels` has each place of a tile once.

    Pixels are gathered by tile and the gaps between them filled in there: no grid is shuffled or joined, and what follows finds a
    tile's pixels in one place.
    """
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    return to_pixels(_arrays(pixels, rows, cols, keys, F.col("v").isNotNull() & inside), keys)


def to_tiles(pixels: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, h, w, data: a row a tile, row by row, NULL where there is no value; `pixels` has each place of a tile once.

    Pixels that lie together by any of the keys, as those of tables.pixels() do, aren't shuffled.
    """
    return _arrays(pixels.where("v IS NOT NULL"), rows, cols, keys)


def _arrays(pixels: DataFrame, rows: int, cols: int, keys: tuple[str, ...], where: Column | None = None) -> DataFrame:
    """to_tiles() of the pixels that meet a condition, and an empty tile where none does. The array is put together from the sorted
    values and the gaps after each, in one pass."""
    none = F.lit(None).cast(dict(pixels.dtypes)["v"])
    place = F.struct((F.col("row") * cols + F.col("col")).cast("int").alias("k"), "v")
    tiles = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(place if where is None else F.when(where, place))).alias("_s"))
    after = lambda i: F.coalesce(F.get("_s", i + 1)["k"], F.lit(rows * cols))
    parts = F.transform("_s", lambda x, i: F.concat(F.array(x["v"]), F.array_repeat(none, after(i) - x["k"] - 1)))
    first = F.coalesce(F.get("_s", F.lit(0))["k"], F.lit(rows * cols))
    data = F.flatten(F.concat(F.array(F.array_repeat(none, first)), parts))
    return tiles.select(*keys, F.lit(rows).alias("h"), F.lit(cols).alias("w"), data.alias("data"))


def to_pixels(tiles: DataFrame, keys: tuple[str, ...] = TILE) -> DataFrame:
    at = tiles.select(*keys, "w", F.posexplode("data").alias("i", "v"))
    return at.select(*keys, F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), (F.col("i") % F.col("w")).cast("int").alias("col"), "v")


def zoomed(pixels: DataFrame, k: int, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Rasters k times as large by bilinear interpolation, corner pixels on corner pixels; missing pixels count as 0, and what
    only they make up is missing. A tile is enlarged where its pixels are gathered; what it is enlarged to isn't shuffled."""

    def weights(n: int) -> np.ndarray:
        return np.maximum(1 - np.abs(np.arange(n * k)[:, None] * (max(1, n - 1) / (n * k - 1)) - np.arange(n)), 0.0) if n * k > 1 else np.ones((1, 1))

    down, across = weights(rows), weights(cols)

    def enlarged(a: np.ndarray) -> np.ndarray:
        v = np.nan_to_num(a)
        some = (down > 0).astype(np.float32) @ (v != 0).astype(np.float32) @ (across > 0).T.astype(np.float32)
        return np.where(some > 0, down @ v @ across.T, np.nan)

    tiles = on_tiles(to_tiles(pixels, rows, cols, keys), enlarged, keys).withColumns({"h": F.lit(rows * k), "w": F.lit(cols * k)})
    return to_pixels(tiles, keys).where("v IS NOT NULL")


def flipped(pixels: DataFrame, rows: int) -> DataFrame:
    return pixels.withColumn("row", F.lit(rows - 1) - F.col("row"))


def survey_counts(points: DataFrame, size: float, x0: float, y0: float, rows: int, cols: int, normalise: bool = False) -> DataFrame:
    """row, col, v: surveys with a sounding in each pixel (not soundings); with `normalise`, per 400 m2."""
    at = points.select("cdi", F.floor((F.col("n") - y0) / size).cast("int").alias("row"), F.floor((F.col("e") - x0) / size).cast("int").alias("col"))
    at = at.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    v = F.count_distinct("cdi")
    return at.groupBy("row", "col").agg((v / (size * size / 400) if normalise else v).alias("v"))


def point_counts(points: DataFrame, size: float, x0: float, y0: float, rows: int, cols: int) -> DataFrame:
    """row, col, v: soundings per bin; the last bins hold their upper edge."""
    last = lambda v, o, n: F.least(F.floor((F.col(v) - o) / size), F.lit(n - 1)).cast("int")
    at = points.where(F.col("e").between(x0, x0 + cols * size) & F.col("n").between(y0, y0 + rows * size))
    return at.groupBy(last("n", y0, rows).alias("row"), last("e", x0, cols).alias("col")).agg(F.count(F.lit(1)).alias("v"))


def position_grid(points: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """row, col, n: positions (lat, lon) with both coordinates, neither NULL nor NaN, in bins of `size` degrees from the least ones less
    `margin` on. An error if the size isn't positive or there is no such position."""
    if size <= 0:
        raise ValueError("the size of a bin must be positive")
    good = points.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")
    low = good.agg(F.min("lat"), F.min("lon")).first()
    if low[0] is None:
        raise ValueError("no position has both coordinates")
    at = lambda c, v: F.floor((F.col(c) - (F.lit(v) - F.lit(float(margin)))) / size).cast("int")
    return good.groupBy(at("lat", low[0]).alias("row"), at("lon", low[1]).alias("col")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, v: str, low: float, high: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of equal bins; the last one holds its upper edge."""
    at = F.least(F.floor((F.col(v) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(v).between(low, high)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gaps_filled(pixels: DataFrame, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Pixels of dense tiles, with the mean of the four neighbours where only the pixel itself is missing.

    All read the values before filling. Neighbours are looked up along rows and columns; no pixel is sent more than once.
    """
    across, down = (Window.partitionBy(*keys, a).orderBy(b) for a, b in (("row", "col"), ("col", "row")))
    near = {"_w": F.lag("v").over(across), "_e": F.lead("v").over(across), "_n": F.lag("v").over(down), "_s": F.lead("v").over(down)}
    mean = (F.col("_n") + F.col("_s") + F.col("_w") + F.col("_e")) / 4  # NULL if one of them is
    return pixels.withColumns(near).select(*keys, "row", "col", F.coalesce("v", mean).alias("v"))


def first_of_equal(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
