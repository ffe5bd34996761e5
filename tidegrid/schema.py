"""Tables of the engine. A pixel without a value is NULL or absent, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURVEYS = "cdi long, local_id string, datum string, start_date date, end_date date, year int, rejected int, density double"
SOUNDINGS = "cdi long, seq long, lat double, lon double, e double, n double, depth double"
GRID_CELLS = "cell int, x0 double, y0 double"
PIXELS = "cell int, cdi long, row int, col int, v double"
TILES = "cell int, cdi long, h int, w int, data array<double>"
PAIR_PIXELS = "cell int, id_new long, id_old long, dt int, row int, col int, v double"
COST = "row int, col int, v double"
PATHS = "run_id long, scenario string, step int, row int, col int, heading int, g double"


def not_nan(v: Column | str) -> Column:
    """NULL for NaN, so that the built-in aggregates skip it."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(~F.isnan(v), v)


def without_nans(df: DataFrame) -> DataFrame:
    """All float columns with NULL for NaN; done once, where data comes in."""
    return df.withColumns({c: not_nan(c) for c, t in df.dtypes if t in ("double", "float")})
