"""The cost map: layers of one grid. NULL is no data; values of 0 and less block the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.coords import cell_window


def placed(pixels: DataFrame) -> DataFrame:
    """Pixels of analysis cells (cell, row, col, v; row 0 south) on the whole map."""
    r, c = cell_window(F.col("cell"))
    return pixels.select((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), "v")


def flagged(layer: DataFrame, threshold: float) -> DataFrame:
    """1 above the threshold, else NULL."""
    return layer.withColumn("v", F.when(F.col("v") > threshold, F.lit(1.0)))


def label_cost(layer: DataFrame) -> DataFrame:
    """Labels with NULL for -1."""
    return layer.withColumn("v", F.nullif(F.col("v"), F.lit(-1.0)))


def layer_sum(*layers: DataFrame) -> DataFrame:
    """Sum of the layers, of what there is; NULL only where all are."""
    return reduce(DataFrame.unionByName, layers).groupBy("row", "col").agg(F.sum("v").alias("v"))


def with_nulls_of(layer: DataFrame, other: DataFrame) -> DataFrame:
    """NULL wherever `other` has no value."""
    o = other.select("row", "col", F.col("v").alias("_o"))
    return layer.join(o, ["row", "col"], "left").withColumn("v", F.when(F.col("_o").isNotNull(), F.col("v"))).drop("_o")


def window(row: int, col: int, row_end: int | None = None, col_end: int | None = None) -> Column:
    """A pixel, or the rectangle up to but without the end."""
    if row < 0 or col < 0:
        raise IndexError("outside the map")
    return F.col("row").between(row, (row_end or row + 1) - 1) & F.col("col").between(col, (col_end or col + 1) - 1)


def set_cost(layer: DataFrame, where: Column, cost: float) -> DataFrame:
    return layer.withColumn("v", F.when(where, F.lit(float(cost))).otherwise(F.col("v")))


def add_cost(layer: DataFrame, where: Column, cost: float) -> DataFrame:
    return layer.withColumn("v", F.when(where, F.coalesce("v", F.lit(0.0)) + cost).otherwise(F.col("v")))


def multiply_cost(layer: DataFrame, where: Column, factor: float) -> DataFrame:
    return layer.withColumn("v", F.when(where, F.col("v") * factor).otherwise(F.col("v")))


def blocked(layer: DataFrame, cells: DataFrame) -> DataFrame:
    """-1 at the pixels (row, col) of `cells`."""
    mark = cells.select("row", "col").distinct().withColumn("_x", F.lit(True))
    return layer.join(mark, ["row", "col"], "left").withColumn("v", F.when(F.col("_x"), F.lit(-1.0)).otherwise(F.col("v"))).drop("_x")


def filled_high(layer: DataFrame, high: float | None = None) -> DataFrame:
    """NULL becomes `high`, by default the map's largest cost, which one row brings."""
    if high is not None:
        return layer.withColumn("v", F.coalesce("v", F.lit(float(high))))
    top = layer.agg(F.max("v").alias("_top"))
    return layer.crossJoin(F.broadcast(top)).withColumn("v", F.coalesce("v", "_top")).drop("_top")  # one row


def noisy(layer: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise on values that are neither NULL nor 0, from a hash of the pixel, so that reruns agree."""
    def u(k: int) -> Column:
        keys = [c for c in ("run_id", "row", "col") if c in layer.columns]
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return layer.withColumn("v", F.when(F.col("v") != 0, F.col("v") + sigma * z).otherwise(F.col("v")))


def cost_at(places: DataFrame, layer: DataFrame) -> DataFrame:
    """`places` (row, col and others) with v, the layer's cost there; those beside the map are left out."""
    return places.join(layer.select("row", "col", "v"), ["row", "col"]).select(*places.columns, "v")


def passable(v: Column) -> Column:
    return (v > 0) & (v < float("inf"))


def flagged_shares(layer: DataFrame, thresholds: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of the valid pixels above each threshold."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    each = layer.where("v IS NOT NULL").select(*keys, "v", t)
    return each.groupBy(*keys, "threshold").agg(F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("share"))
