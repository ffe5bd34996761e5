"""Spectra of tiles: ways to pad, masks in the frequency plane, and sweeps over parameters, a tile a row.

A mask turned by an angle is computed from its angle; nothing is rotated as an image.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import TILE, band, filled, nearest, on_tiles, smooth, surface, taper


def sweep(tiles: DataFrame, f: Callable[[np.ndarray, float], Sequence[float]], name: str, values: Sequence, columns: Sequence[str], keys: tuple[str, ...] = TILE) -> DataFrame:
    """keys, `name`, columns: f(raster, value) for each value. A tile is sent to Python once for all values; NaN becomes NULL."""
    found = on_tiles(tiles, lambda a: np.array([f(a, v) for v in values], float), keys)
    rows = [F.struct(F.lit(v).alias(name), *(F.col("data")[i * len(columns) + j].alias(c) for j, c in enumerate(columns))) for i, v in enumerate(values)]
    return found.select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*")


def fill_stages(a: np.ndarray, degree: int = 2, reach: float = 15.0, sigma: float = 2.0) -> dict[str, np.ndarray]:
    """A tile with its holes filled by the nearest value, by a surface, by both blended with distance, and smoothed."""
    ok = np.isfinite(a)
    if not ok.any():
        return dict.fromkeys(("nearest", "surface", "blended", "smoothed"), np.zeros_like(a))
    _, at = nearest(ok)
    return {"nearest": a.ravel()[at], "surface": np.where(ok, a, surface(a, degree)), "blended": filled(a, degree, reach), "smoothed": filled(a, degree, reach, sigma)}


def padding(shape: tuple[int, int], how: str) -> list[tuple[int, int]]:
    """Pixels before and after each axis: none, half of the larger side, the whole side, or up to the next power of two."""
    if how == "none":
        return [(0, 0), (0, 0)]
    if how == "half":
        return [(max(shape) // 2,) * 2] * 2
    if how == "whole":
        return [(n, n) for n in shape]
    if how == "power":
        more = [(1 << (n - 1).bit_length()) - n for n in shape]
        return [(m // 2, m - m // 2) for m in more]
    raise ValueError(f"unknown padding {how}")


def transformed(a: np.ndarray, window: str | None = None, how: str = "none", least: float = 1e-2) -> np.ndarray:
    """Shifted transform of a tile without holes; padding to a power of two repeats the tile, other padding is 0."""
    if window:
        a = a * np.maximum(np.outer(*(taper(n, window) for n in a.shape)), least)
    return np.fft.fftshift(np.fft.fft2(np.pad(a, padding(a.shape, how), mode="wrap" if how == "power" else "constant")))


def restored(f: np.ndarray, shape: tuple[int, int], how: str = "none", window: str | None = None, least: float = 1e-2) -> np.ndarray:
    """The tile of a transform, cut to its shape and divided by the window."""
    (top, _), (left, _) = padding(shape, how)
    a = np.fft.ifft2(np.fft.ifftshift(f)).real[top : top + shape[0], left : left + shape[1]]
    return a / np.maximum(np.outer(*(taper(n, window) for n in shape)), least) if window else a


def middle(n: int, width: int) -> np.ndarray:
    """True for the `width` places before the middle and as many from it on."""
    at = np.arange(n) - n // 2
    return (at >= -width) & (at < width)


def low_passed(a: np.ndarray, cutoff: int = 4) -> np.ndarray:
    """What the frequencies in a square around 0 make up."""
    return restored(transformed(a) * np.outer(*(middle(n, cutoff) for n in a.shape)), a.shape)


def axis_notch(shape: tuple[int, int], width: int = 5, both: bool = True) -> np.ndarray:
    """True along the horizontal axis, or along both axes, but for the square in the middle."""
    y, x = (middle(n, width) for n in shape)
    line = np.broadcast_to(y[:, None], shape)
    return (line | x if both else line) & ~np.outer(y, x)


def gaussian_notch(shape: tuple[int, int], bandwidth: float = 0.02) -> np.ndarray:
    """Factors from 0 at the middle column to 1 away from it."""
    k = np.linspace(-0.5, 0.5, shape[1])
    return np.broadcast_to(1 - np.exp(-(k**2) / (2 * bandwidth**2)), shape)


def cone(shape: tuple[int, int], angle: float, half: float = 15.0) -> np.ndarray:
    """True where the direction from the middle is within `half` degrees of an angle, either way round; the middle itself is in every cone."""
    y, x = (np.arange(n) - n // 2 for n in shape)
    off = (np.degrees(np.arctan2(y[:, None], x[None, :])) - angle + 90) % 180 - 90
    return (np.abs(off) <= half) | ((y == 0)[:, None] & (x == 0)[None, :])


def detrended(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Trend and residual of a filled tile; they add up to it."""
    whole = filled(a)
    trend = smooth(whole, sigma)
    return trend, whole - trend


def strongest(f: np.ndarray, masks: dict[float, np.ndarray]) -> tuple[float, float]:
    """The angle whose mask has the largest mean amplitude, the first of equal ones, and that mean."""
    means = {angle: float(f[m].mean()) for angle, m in masks.items()}
    angle = max(means, key=lambda t: (means[t], -t))
    return angle, means[angle]


def cone_angle(a: np.ndarray, half: float = 15.0, step: float = 5.0, sigma: float = 6.0) -> tuple[float, float]:
    """Angle and response of the strongest cone of the detrended tile, windowed and padded by its whole size."""
    f = np.log(np.abs(transformed(detrended(a, sigma)[1], "hann", "whole", 0.0)) + 1)
    return strongest(f, {t: cone(f.shape, t, half) for t in np.arange(0, 180, step)})


def cross_angle(a: np.ndarray, width: float = 5.0, step: float = 1.0, sigma: float = 6.0) -> tuple[float, float]:
    """Angle, below 90, and response of the strongest pair of lines at right angles."""
    f = np.abs(transformed(detrended(a, sigma)[1], None, "power"))
    return strongest(f, {t: band(f.shape, t, width, width) | band(f.shape, t + 90, width, width) for t in np.arange(0, 90, step)})
