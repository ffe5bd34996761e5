"""Thinning of masks of lines to one pixel, over the whole map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import saved

#: Pixels along a tile's side, and rounds that a tile is thinned by before it looks at its neighbours again.
SIDE, ROUNDS = 256, 8
#: Neighbours, going round from the east against the clock (row 0 south): bit i of a code is neighbour i.
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
#: The sides that a pixel is taken from, in turns: north, south, east, west.
SIDES = (2, 6, 0, 4)


def removable(code: int, side: int) -> bool:
    """Whether a pixel with these neighbours may go from a side: it has none there, at least two elsewhere, and without it they
    still hang together. Taking all such pixels from one side at once keeps what hangs together, ends of lines and whole parts."""
    x = [(code >> (i % 8)) & 1 for i in range(10)]
    # runs of neighbours that touch each other, a diagonal one counting as a link
    runs = sum((1 - x[i]) - (1 - x[i]) * (1 - x[i + 1]) * (1 - x[i + 2]) for i in (0, 2, 4, 6))
    return not x[side] and sum(x[:8]) > 1 and runs == 1


STAYS = np.array([[not removable(code, side) for code in range(256)] for side in SIDES])


def _taken(mask: np.ndarray) -> bool:
    """One round over the four sides on a mask with a border of False, in place; whether a pixel went."""
    n, (h, w) = mask.sum(), mask.shape
    for stays in STAYS:
        code = np.zeros((h - 2, w - 2), np.uint8)
        for i, (r, c) in enumerate(AROUND):
            code |= mask[1 + r : h - 1 + r, 1 + c : w - 1 + c].astype(np.uint8) << i
        mask[1:-1, 1:-1] &= stays[code]
    return mask.sum() < n


def thinned(cells: DataFrame, keys: tuple[str, ...] = (), side: int = SIDE, rounds: int = ROUNDS) -> DataFrame:
    """The pixels `cells` (keys, row, col) of masks thinned to lines of one pixel, diagonal steps clean; each key's mask by itself.

    In a step those pixels that may go from one side, by their eight neighbours, go all at once; rounds over the four sides until
    nothing goes, one for every two pixels of width. Lines are 8-connected after as before, and no part vanishes.

    Masks are cut to tiles of `side` pixels, the first one around 0. What becomes of a pixel in `rounds` rounds depends on those up to
    4 * rounds pixels away, so a tile gets them too. A tile with nothing around it is thinned to its end at once; the others take
    `rounds` more, until no pixel goes. No task holds more than a tile and what is around it.
    """
    kinds, margin = dict(cells.dtypes), 4 * rounds
    half = side // 2
    tile_of = lambda c, by=0: F.floor((F.col(c) + (half + by)) / side)

    def thin(t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        r0, c0 = (t.column(c)[0].as_py() * side - half for c in ("_r", "_c"))
        top, left = row.min() - 1, col.min() - 1
        mask = np.zeros((row.max() - top + 2, col.max() - left + 2), bool)
        mask[row - top, col - left] = True
        inside = (row >= r0) & (row < r0 + side) & (col >= c0) & (col < c0 + side)
        whole, n = bool(inside.all()), 0
        while inside.any() and (whole or n < rounds) and _taken(mask):
            n += 1
        y, x = np.nonzero(mask)
        y, x = y + top, x + left
        own = (y >= r0) & (y < r0 + side) & (x >= c0) & (x < c0 + side)
        y, x = y[own], x[own]
        out = {k: t.column(k).take(pa.array(np.zeros(len(y), np.int64))) for k in keys}
        return pa.table({**out, "row": pa.array(y).cast(t.schema.field("row").type), "col": pa.array(x).cast(t.schema.field("col").type), "whole": pa.array(np.full(len(y), whole))})

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "row", "col")) + ", whole boolean"
    left, before = cells.select(*keys, "row", "col"), None
    while True:
        # a pixel goes to its tile, and to those that it lies around
        spread = left.withColumn("_r", F.explode(F.sequence(tile_of("row", -margin), tile_of("row", margin))))
        spread = spread.withColumn("_c", F.explode(F.sequence(tile_of("col", -margin), tile_of("col", margin))))
        left = saved(spread.groupBy(*keys, "_r", "_c").applyInArrow(thin, schema))
        n, cut = left.agg(F.count(F.lit(1)), F.count(F.when(~F.col("whole"), 1))).first()
        left = left.drop("whole")
        if not cut or n == before:
            return left
        before = n
