"""Numeric steps on one tile at a time: filling, detrending, spectra and notches.

A tile is a row (keys, h, w, data), so the tiles are spread like any rows and a task holds a few at a time.
Everything that is a sum, a join or an order is left to DataFrame operations; see stripe_angles().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import relative_height, smooth

TILE = ("cell", "cdi")


def on_tiles(tiles: DataFrame, f: Callable[..., np.ndarray], keys: tuple[str, ...] = TILE, extra: tuple[str, ...] = ()) -> DataFrame:
    """`tiles` with data = f(raster, *extra columns); NaN is NULL outside and the other way round inside."""
    kinds = dict(tiles.dtypes)
    names = [*keys, "h", "w"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                h, w = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                a = row.column("data")[0].values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w)
                out = f(a, *(row.column(c)[0].as_py() for c in extra)).ravel()
                data = pa.array(out, mask=~np.isfinite(out))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names), pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), data)], [*names, "data"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", data array<double>"
    return tiles.select(*names, "data", *(c for c in extra if c not in names)).mapInArrow(mapped, schema)


def nearest(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the nearest valid pixel, and its flat index; exact, first along rows, then over the rows, one column at a time."""
    h, w = valid.shape
    cols = np.arange(w)
    before = np.maximum.accumulate(np.where(valid, cols, -(10**6)), axis=1)
    after = np.minimum.accumulate(np.where(valid, cols, 10**6)[:, ::-1], axis=1)[:, ::-1]
    col = np.where(cols - before <= after - cols, before, after)
    gap = (col - cols).astype(float) ** 2
    apart = (np.arange(h)[:, None] - np.arange(h)[None, :]).astype(float) ** 2
    row, at = np.empty((h, w), np.int64), np.empty((h, w))
    for c in range(w):
        d2 = apart + gap[None, :, c]
        row[:, c] = d2.argmin(axis=1)
        at[:, c] = d2.min(axis=1)
    return np.sqrt(at), row * w + np.clip(col[row, cols[None, :]], 0, w - 1)


def filled_gaps(a: np.ndarray, most: int) -> np.ndarray:
    """Missing pixels in 4-connected gaps of at most `most` pixels get the nearest value; blocked pixels are values too. Larger gaps stay."""
    ok = np.isfinite(a)
    if not ok.any() or ok.all():
        return a
    _, at = nearest(ok)
    label = components4(~ok)
    size = np.bincount(label[~ok], minlength=a.size)
    return np.where(~ok & (size[label] <= most), a.ravel()[at], a)


def components4(mask: np.ndarray) -> np.ndarray:
    """The flat index of the first pixel of each pixel's 4-connected region of true pixels (its own elsewhere)."""
    n = mask.size
    label = np.arange(n)
    index = label.reshape(mask.shape)
    pairs = [(index[:, :-1][m], index[:, 1:][m]) for m in [mask[:, :-1] & mask[:, 1:]]]
    pairs += [(index[:-1][m], index[1:][m]) for m in [mask[:-1] & mask[1:]]]
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label.reshape(mask.shape)
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def surface(a: np.ndarray, degree: int) -> np.ndarray:
    """Least-squares polynomial in centred and scaled row and column."""
    y, x = (np.linspace(-1, 1, n) if n > 1 else np.zeros(1) for n in a.shape)
    terms = np.array([np.outer(y**i, x**j) for i in range(degree + 1) for j in range(degree + 1 - i)])
    ok = np.isfinite(a)
    c = np.linalg.lstsq(terms[:, ok].T, a[ok], rcond=None)[0]
    return np.tensordot(c, terms, 1)


def filled(a: np.ndarray, degree: int = 2, reach: float = 15.0, sigma: float = 0.0, passes: int = 3) -> np.ndarray:
    """Holes get the nearest value, more and more of a polynomial surface with distance, and are smoothed."""
    ok = np.isfinite(a)
    if not ok.any():
        return np.zeros_like(a)
    d, at = nearest(ok)
    t = np.clip(d / reach, 0, 1) ** 2
    out = np.where(ok, a, (1 - t) * a.ravel()[at] + t * surface(a, degree))
    for _ in range(passes if sigma > 0 else 0):
        out = np.where(ok, a, smooth(out, sigma))
    return out


def taper(n: int, kind: str) -> np.ndarray:
    if kind == "hann":
        return np.hanning(n)
    if kind == "hamming":
        return np.hamming(n)
    if kind == "tukey":
        t = np.minimum(np.arange(n), np.arange(n)[::-1]) / max(1.0, (n - 1) / 4)
        return np.where(t < 1, 0.5 * (1 - np.cos(np.pi * t)), 1.0)
    raise ValueError(f"unknown window {kind}")


def spectrum(a: np.ndarray, window: str | None = None) -> np.ndarray:
    """Shifted transform of a tile, padded with half its size on each side."""
    if window:
        a = a * np.maximum(np.outer(*(taper(n, window) for n in a.shape)), 1e-2)
    pad = max(a.shape) // 2
    return np.fft.fftshift(np.fft.fft2(np.pad(a, pad)))


def band(shape: tuple[int, int], angle: float, width: float, centre: float) -> np.ndarray:
    """Pixels within `width` of the line through the middle at an angle, but for the middle itself."""
    y, x = (np.arange(n) - n // 2 for n in shape)
    t = np.radians(angle)
    off = np.abs(x[None, :] * np.sin(t) - y[:, None] * np.cos(t))
    return (off <= width) & ~((np.abs(y)[:, None] < centre) & (np.abs(x)[None, :] < centre))


def destriped(a: np.ndarray, angle: float, sigma: float = 6.0, width: float = 5.0, centre: float = 15.0) -> np.ndarray:
    """A tile without the stripes whose spectrum lies along `angle`; holes stay holes."""
    ok = np.isfinite(a)
    whole = filled(a)
    trend = smooth(whole, sigma)
    f = spectrum(whole - trend)
    f = f * ~band(f.shape, angle, width, centre)
    pad = max(a.shape) // 2
    out = np.fft.ifft2(np.fft.ifftshift(f)).real[pad : pad + a.shape[0], pad : pad + a.shape[1]] + trend
    return np.where(ok, out, np.nan)


def angle_responses(tiles: DataFrame, sigma: float = 6.0, width: float = 5.0, centre: float = 15.0, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, angle (0 to 179), v: mean log-amplitude of the detrended tile's spectrum along each angle."""

    def responses(a: np.ndarray) -> np.ndarray:
        whole = filled(a)
        f = np.log(np.abs(spectrum(whole - smooth(whole, sigma), "hann")) + 1)
        return np.array([f[band(f.shape, t, width, centre)].mean() for t in range(180)])

    return on_tiles(tiles, responses, keys).select(*keys, F.posexplode("data").alias("angle", "v"))


def stripe_angles(tiles: DataFrame, keys: tuple[str, ...] = TILE, **how) -> DataFrame:
    """keys, angle: where a tile's response stands out most from its neighbours' in the circle; ties to the smaller."""
    heights = relative_height(angle_responses(tiles, keys=keys, **how), 180, keys)
    best = F.max(F.struct("height", (-F.col("angle")).alias("a")))
    return heights.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.a")).alias("angle"), F.col("b.height").alias("height"))


def destripe(tiles: DataFrame, keys: tuple[str, ...] = TILE, angles: DataFrame | None = None, **how) -> DataFrame:
    """Tiles without their stripes; `angles` (keys, angle) overrides what is found."""
    angles = angles if angles is not None else stripe_angles(tiles, keys)
    return on_tiles(tiles.join(angles.select(*keys, "angle"), list(keys)), lambda a, t: destriped(a, t, **how), keys, ("angle",))


def prominence(tiles: DataFrame, angles: DataFrame, width: float = 5.0, centre: float = 15.0, keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, v: mean log-amplitude along a tile's angle over that of the rest."""

    def ratio(a: np.ndarray, t: float) -> np.ndarray:
        f = np.log(np.abs(spectrum(filled(a) - smooth(filled(a), 6.0), "hann")) + 1)
        own, middle = band(f.shape, t, width, centre), band(f.shape, t, 10**6, centre)
        return np.array([f[own].mean() / f[middle & ~own].mean()])

    return on_tiles(tiles.join(angles.select(*keys, "angle"), list(keys)), ratio, keys, ("angle",)).select(*keys, F.col("data")[0].alias("v"))
