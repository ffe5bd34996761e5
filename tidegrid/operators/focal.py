"""Neighbourhoods of pixels, separable wherever the operator is.

A raster is filtered along its columns and then along its rows. Tiles, whose size is bounded, are the groups: one is
filtered as an array, so its pixels are sent once whatever the filter, and all that is wanted of a tile is found in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = ("cell", "cdi")


def frame(size: int) -> tuple[int, int]:
    """Offsets of a window of `size`; of an even one, the longer arm lies before."""
    return -(size // 2), size - size // 2 - 1


def _summed(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums over a moving window along an axis, beyond whose ends the array is mirrored; in the order of the window."""
    n, arm = a.shape[axis], size // 2
    at = np.arange(-arm, n + arm)
    at = np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at))
    inside = (at >= 0) & (at < n)  # a mirror shows no more than the array
    wide = np.take(a, np.where(inside, at, 0), axis) * np.expand_dims(inside, 1 - axis)
    return sum(np.take(wide, np.arange(d, d + n), axis) for d in range(size))


def _moments(a: np.ndarray, there: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, mean and variance of the values in windows; a window's rows are summed at the pixels that are `there`."""
    ok = np.isfinite(a)
    v = np.where(ok, a, 0.0)
    s, q, k = (_summed(np.where(there, _summed(x, size, 0), 0.0), size, 1) for x in (v, v * v, ok.astype(float)))
    n = np.where(k > 0, k, np.nan)
    return k, s / n, np.maximum(q / n - (s / n) * (s / n), 0.0)


def local_moments(pixels: DataFrame, size: int, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, row, col, n, mean, var: of the values in size x size windows, mirrored at the edges.

    Sums of value, square and count are separable, so the work is two passes over a tile's array whatever the size.
    """
    f = lambda a, there: dict(zip(("n", "mean", "var"), _moments(a, there, size)))
    return _of_rasters(pixels, f, {"n": "long", "mean": "double", "var": "double"}, rows, cols, keys)


def local_stds(pixels: DataFrame, sizes: tuple[int, ...], rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, row, col, v and s<size> for each of the sizes: local_std() of all in one pass."""
    f = lambda a, there: {"v": a, **{f"s{s}": np.sqrt(_moments(a, there, s)[2]) for s in sizes}}
    return _of_rasters(pixels, f, {"v": "double", **{f"s{s}": "double" for s in sizes}}, rows, cols, keys)


def local_std(pixels: DataFrame, size: int, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    return local_moments(pixels, size, rows, cols, keys).select(*keys, "row", "col", F.sqrt("var").alias("v"))


def local_variance(pixels: DataFrame, size: int, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    return local_moments(pixels, size, rows, cols, keys).select(*keys, "row", "col", F.col("var").alias("v"))


def _extreme(a: np.ndarray, there: np.ndarray, size: int, how: str) -> np.ndarray:
    """`min` or `max` over the values in windows, NaN where there is none; a window's rows are looked at where pixels are `there`."""
    least = -np.inf if how == "max" else np.inf
    f = np.maximum if how == "max" else np.minimum
    a = np.where(np.isnan(a), least, a)
    for axis in (0, 1):
        low, high = -frame(size)[0], frame(size)[1]
        wide = np.pad(np.where(there, a, least), [(low, high) if x == axis else (0, 0) for x in (0, 1)], constant_values=least)
        n = a.shape[axis]
        a = np.take(wide, np.arange(n), axis)
        for d in range(1, size):
            a = f(a, np.take(wide, np.arange(d, d + n), axis))
    return np.where(np.isinf(a), np.nan, a)


def extreme(pixels: DataFrame, size: int, how: str, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """`min` or `max` of size x size windows; repeating the edge changes neither, so none is."""
    kind = dict(pixels.dtypes)["v"]
    return _of_rasters(pixels, lambda a, there: {"v": _extreme(a, there, size, how)}, {"v": "double"}, rows, cols, keys).withColumn("v", F.col("v").cast(kind))


# Sobel's weights.
SOBEL = {(-1, -1): 1, (-1, 1): -1, (0, -1): 2, (0, 1): -2, (1, -1): 1, (1, 1): -1}


def sobel_magnitude(pixels: DataFrame, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Gradient of the inner pixels whose eight neighbours have values, wherever in the tile they lie."""
    names, kinds = [*keys, "row", "col"], dict(pixels.dtypes)

    def mapped(t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy() for c in ("row", "col"))
        r0, c0 = row.min(), col.min()
        a = np.full((max(3, row.max() - r0 + 1), max(3, col.max() - c0 + 1)), np.nan)
        a[row - r0, col - c0] = t.column("v").to_numpy()
        h, w = a.shape
        gx, gy = (sum(x * a[1 + y : h - 1 + y, 1 + z : w - 1 + z] for (y, z), x in k.items()) for k in (SOBEL, {(c, r): v for (r, c), v in SOBEL.items()}))
        out = np.hypot(gx, gy)
        r, c = np.nonzero(np.isfinite(out))
        own = {k: t.column(k).slice(0, 1).take(pa.array(np.zeros(len(r), np.int64))) for k in keys}
        at = {k: pa.array(x).cast(t.schema.field(k).type) for k, x in (("row", r + 1 + r0), ("col", c + 1 + c0))}
        return pa.table({**own, **at, "v": pa.array(out[r, c])})

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", v double"
    return pixels.where("v IS NOT NULL").select(*names, F.col("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(mapped, schema)


def slopes(a: np.ndarray) -> np.ndarray:
    """Length of the gradient of a raster by central differences, one-sided at the edges."""
    each = []
    for axis in (0, 1):
        b = np.moveaxis(a, axis, 0)
        g = np.full(b.shape, np.nan)
        if len(b) > 1:
            g[0], g[-1], g[1:-1] = b[1] - b[0], b[-1] - b[-2], (b[2:] - b[:-2]) / 2
        each.append(np.moveaxis(g, 0, axis))
    return np.hypot(*each)


def gradient_magnitude(pixels: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Central differences, one-sided at the edges of dense tiles; NULL where a neighbour has no value."""
    return on_rasters(pixels, slopes, rows, cols, keys)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(a: np.ndarray, sigma: float, mode: str = "symmetric") -> np.ndarray:
    """Gaussian filter of a raster; beyond its edges it goes on as `mode` of numpy's pad says."""
    w = np.array(gaussian_weights(sigma))
    for axis in (0, 1):
        wide = np.pad(a, [(len(w) // 2,) * 2 if x == axis else (0, 0) for x in (0, 1)], mode=mode)
        a = np.lib.stride_tricks.sliding_window_view(wide, len(w), axis) @ w[::-1]
    return a


def on_rasters(pixels: DataFrame, f: Callable[[np.ndarray], np.ndarray], rows: int, cols: int, keys: tuple[str, ...]) -> DataFrame:
    """`pixels` (keys, row, col, v) with v = f(raster), a tile in a group; missing values are NaN inside and NULL outside."""
    return _of_rasters(pixels, lambda a, _: {"v": f(a)}, {"v": "double"}, rows, cols, keys)


def _of_rasters(pixels: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: dict[str, str], rows: int, cols: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, row, col and the columns that f(raster, which pixels there are) gives: several results of a tile in one pass."""
    names, kinds = [*keys, "row", "col"], dict(pixels.dtypes)
    whole = {c: pa.int64() for c, k in columns.items() if k == "long"}

    def mapped(t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy() for c in ("row", "col"))
        a, there = np.full((rows, cols), np.nan), np.zeros((rows, cols), bool)
        a[row, col], there[row, col] = t.column("v").to_numpy(), True
        found, out = f(a, there), t.select(names)
        for c in columns:
            x = found[c][row, col]
            out = out.append_column(c, pa.array(x, mask=~np.isfinite(x)).cast(whole.get(c, pa.float64())))
        return out

    schema = ", ".join(f"{c} {k}" for c, k in [*((c, kinds[c]) for c in names), *columns.items()])
    return pixels.select(*names, F.col("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(mapped, schema)


def weighted(a: np.ndarray, sigma: float, mode: str = "symmetric") -> np.ndarray:
    """Weighted values over the weights there are; NaN where there is none within reach."""
    ok = np.isfinite(a)
    value, weight = smooth(np.where(ok, a, 0.0), sigma, mode), smooth(ok.astype(float), sigma, mode)
    return np.divide(value, weight, out=np.full(a.shape, np.nan), where=weight > 0)


def gaussian(pixels: DataFrame, sigma: float, rows: int, cols: int, normalise: bool = True, keys: tuple[str, ...] = TILE, mode: str = "symmetric") -> DataFrame:
    """Gaussian filter, mirrored at the edges. With `normalise`, missing values count for nothing: weighted
    values over the weights there are; else a missing value is 0. A tile, whose size is bounded, is filtered as one array."""
    return on_rasters(pixels, lambda a: weighted(a, sigma, mode) if normalise else smooth(np.nan_to_num(a), sigma, mode), rows, cols, keys)


def smooth_filled(pixels: DataFrame, sigma: float, rows: int, cols: int, keys: tuple[str, ...] = TILE, mode: str = "edge", most: int | None = None) -> DataFrame:
    """Dense tiles whose missing pixels get the weighted mean of the values within reach of a Gaussian; where none is in reach, of those
    filled before, until none is missing or `most` passes are over. Values stay as they are; filling keeps to the mean, as weights are shares. A tile without a
    value stays empty."""

    def fill(a: np.ndarray) -> np.ndarray:
        passes = 0
        while passes != most and not (ok := np.isfinite(a)).all() and ok.any():
            passes += 1
            a = np.where(ok, a, weighted(a, sigma, mode))
        return a

    return on_rasters(pixels, fill, rows, cols, keys)


def relative_height(responses: DataFrame, n: int, keys: tuple[str, ...] = TILE) -> DataFrame:
    """Response (angle 0 to n - 1, v) less the mean of the eight around it in the circle, four before to three after."""
    three = responses.withColumn("angle", F.explode(F.array(F.col("angle"), F.col("angle") - n, F.col("angle") + n)))
    w = Window.partitionBy(*keys).orderBy("angle").rowsBetween(-4, 3)
    return three.withColumn("height", F.col("v") - F.avg("v").over(w)).where(F.col("angle").between(0, n - 1))
