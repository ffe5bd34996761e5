"""Change between surveys: pairs of rasters, their statistics, rates and shifts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("cell", "id_old", "id_new", "dt")


def pairs(pixels: DataFrame, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """keys, row, col, id_old, id_new, dt, old, new, diff: pixels that both surveys of a pair have, the later year new.

    One self-join on the pixel; pairs of one year are left out, as are surveys without a year.
    """
    k = [*keys, "row", "col"]
    old = pixels.select(*k, F.col("cdi").alias("id_old"), F.col("year").alias("y0"), F.col("v").alias("old"))
    new = pixels.select(*k, F.col("cdi").alias("id_new"), F.col("year").alias("y1"), F.col("v").alias("new"))
    both = old.join(new, k).where("y1 > y0")
    return both.select(*k, "id_old", "id_new", (F.col("y1") - F.col("y0")).alias("dt"), "old", "new", (F.col("new") - F.col("old")).alias("diff"))


def covered(pair_pixels: DataFrame, total: int, least: float, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """The pixels of the pairs that share more than `least` of a tile's pixels."""
    good = pair_pixels.groupBy(*keys).agg(F.count("diff").alias("_n")).where(F.col("_n") > least * total).drop("_n")
    return pair_pixels.join(good, list(keys))


def rates(pair_pixels: DataFrame, signed: bool = False, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, row, col, v: change a year less the pair's mean change; its size unless `signed`."""
    mean = pair_pixels.groupBy(*keys).agg(F.avg("diff").alias("_mean"))
    out = pair_pixels.join(mean, list(keys))
    v = (F.col("diff") - F.col("_mean")) / F.col("dt")
    return out.select(*keys, "row", "col", (v if signed else F.abs(v)).alias("v"))


def pair_statistics(pair_pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """n, bias, sd (population), rmse, p95 of the absolute difference."""
    d = F.col("diff")
    return pair_pixels.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_pop(d).alias("sd"), F.sqrt(F.avg(d * d)).alias("rmse"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95")
    )


def symmetric_limit(v: Column) -> Column:
    return F.greatest(-F.min(v), F.max(v))


def tile_pairs(tiles: DataFrame, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """keys, id_old, id_new, dt, h, w, old, new: the tiles (keys, cdi, year, h, w, data) of each two surveys of different years, a row each."""
    side = lambda s, y: tiles.select(*keys, F.col("cdi").alias(f"id_{s}"), F.col("year").alias(y), "h", "w", F.col("data").alias(s))
    both = side("old", "y0").join(side("new", "y1"), [*keys, "h", "w"]).where("y1 > y0")
    return both.select(*keys, "id_old", "id_new", (F.col("y1") - F.col("y0")).alias("dt"), "h", "w", "old", "new")


def _overlap(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
    """What of two rasters lies on each other if a[r + dy, c + dx] meets b[r, c]."""
    h, w = a.shape
    return a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)], b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]


def shift_sums(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of a[r + dy, c + dx] - b[r, c] over the pixels that both have, for all dy and dx from -most to most.

    With 0 for what is missing, both are correlations of the values and of the masks, by one transform of each, padded so that
    nothing meets around the edge.
    """
    size = [n + most + 1 for n in a.shape]
    masks, values = [np.isfinite(x) for x in (a, b)], [np.nan_to_num(x) for x in (a, b)]
    ma, mb, va, vb = (np.fft.rfft2(x, size) for x in (*masks, *values))
    both = [np.fft.irfft2(f, size) for f in (ma * mb.conj(), va * mb.conj() - ma * vb.conj())]
    at = np.arange(-most, most + 1)
    n, total = (f[np.ix_(at % size[0], at % size[1])] for f in both)
    reach = (np.abs(at)[:, None] < a.shape[0]) & (np.abs(at)[None, :] < a.shape[1])
    return np.where(reach, np.rint(n), 0).astype(np.int64), np.where(reach, total, 0.0)


def least_mean(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int, float] | None:
    """(dy, dx, n, mean) of the shift with the smallest signed mean difference, ties to the first by column, then row; None without any
    overlap. The transforms tell which shifts may be it; their means are then taken over the pixels."""
    n, total = shift_sums(a, b, most)
    mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)
    if not np.isfinite(mean).any():
        return None
    off = 1e-9 * (1 + np.nanmax(np.abs(a)) + np.nanmax(np.abs(b))) * np.sqrt(a.size)  # beyond what transforms may be wrong by
    found = []
    for i, j in np.argwhere(mean <= mean.min() + off).tolist():
        x, y = _overlap(a, b, i - most, j - most)
        d = x - y
        found.append((round(float(np.nanmean(d)), 9), j - most, i - most, int(np.isfinite(d).sum())))
    v, dx, dy, k = min(found)
    return dy, dx, k, v


def shift_scores(pairs_: DataFrame, most: int = 30, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, dy, dx, n, mean: for every shift of tile_pairs() by up to `most` pixels each way, how many pixels meet and the mean of
    new[row + dy, col + dx] - old[row, col]; shifts at which nothing meets are left out. A pair of tiles is a row, and so are its
    sums; the transforms cost as little as a few shifts would."""
    return _shifted(pairs_, lambda a, b: [(i - most, j - most, int(n[i, j]), float(s[i, j] / n[i, j])) for n, s in [shift_sums(a, b, most)] for i, j in np.argwhere(n > 0).tolist()], keys)


def best_shifts(pairs_: DataFrame, most: int = 30, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, dy, dx, n, mean: of each of tile_pairs() the shift with the smallest signed mean of new less old, each less its own mean;
    ties, after rounding to 9 digits, to the first by column, then row. Pairs that don't meet at any shift are left out."""

    def best(a: np.ndarray, b: np.ndarray) -> list[tuple]:
        if not (np.isfinite(a).any() and np.isfinite(b).any()):
            return []
        got = least_mean(a - np.nanmean(a), b - np.nanmean(b), most)
        return [got] if got else []

    return _shifted(pairs_, best, keys)


def _shifted(pairs_: DataFrame, f: Callable[[np.ndarray, np.ndarray], list[tuple]], keys: tuple[str, ...]) -> DataFrame:
    kinds = dict(pairs_.dtypes)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                shape = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                a, b = (row.column(c)[0].values.to_numpy(zero_copy_only=False).astype(float).reshape(shape) for c in ("new", "old"))
                found = f(a, b)
                again = pa.array(np.zeros(len(found), np.int32))
                own = [row.column(c).take(again) for c in keys]
                types = {"dy": pa.int32(), "dx": pa.int32(), "n": pa.int64(), "mean": pa.float64()}
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x[i] for x in found], t) for i, t in enumerate(types.values()))], [*keys, *types])

    n = int(pairs_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", dy int, dx int, n long, mean double"
    return pairs_.select(*keys, "h", "w", "old", "new").repartition(n, *keys).mapInArrow(mapped, schema)
