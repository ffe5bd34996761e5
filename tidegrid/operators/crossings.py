"""Which square cells of a grid polygons and routes meet, and in which order a route meets them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vector

SEGMENT = ("ax", "ay", "bx", "by")


def _spanned(df: DataFrame, size: float, xs: tuple[str, str], ys: tuple[str, str], margin: int = 0) -> DataFrame:
    """A row per cell that touches the box of each row's ends, as _row and _col, with `margin` more cells around."""
    span = lambda a, b: F.sequence((F.ceil(F.least(a, b) / size) - 1 - margin).cast("int"), (F.floor(F.greatest(a, b) / size) + margin).cast("int"))
    return df.withColumn("_row", F.explode(span(*ys))).withColumn("_col", F.explode(span(*xs)))


def _touches(size: float) -> Column:
    """Whether a segment touches the cell (_row, _col), borders included."""
    return vector.clip_limits(F.col("_col") * size, F.col("_row") * size, (F.col("_col") + 1) * size, (F.col("_row") + 1) * size)[2]


def touched(segments: DataFrame, size: float) -> DataFrame:
    """id, _row, _col: the cells of `size` that segments (id, ax, ay, bx, by) touch, borders included."""
    cells = _spanned(segments.select("id", *SEGMENT), size, ("ax", "bx"), ("ay", "by"))
    return cells.where(_touches(size)).select("id", "_row", "_col").distinct()


def polygon_cells(edges: DataFrame, size: float) -> DataFrame:
    """id, row, col: the cells that polygons meet. `edges`: id, x1, y1, x2, y2.

    A cell that no edge touches lies inside or outside as a whole, so its middle decides. Cells and polygons meet by keys: the cells
    of an edge's box, and bands of the middles.
    """
    on_edge = touched(edges.select("id", *(F.col(a).alias(b) for a, b in zip(("x1", "y1", "x2", "y2"), SEGMENT))), size)
    boxes = edges.groupBy("id").agg(F.min("x1").alias("ax"), F.min("y1").alias("ay"), F.max("x1").alias("bx"), F.max("y1").alias("by"))
    middle = lambda c: (F.col(c) + 0.5) * size
    middles = _spanned(boxes, size, ("ax", "bx"), ("ay", "by")).select("_row", "_col", middle("_col").alias("x"), middle("_row").alias("y")).distinct()
    within = vector.inside(middles, edges, size).select("id", "_row", "_col")
    return on_edge.union(within).distinct().select("id", F.col("_row").alias("row"), F.col("_col").alias("col"))


def cells_along(segments: DataFrame, size: float) -> DataFrame:
    """id, nth, row, col, chainage: the cells that each line touches, by the distance along it of the point nearest to their middle.

    `segments`: id, seq, ax, ay, bx, by. A line that touches a cell passes its middle within 0.71 of `size`, so only segments that do
    are compared; of equal distances the first segment's counts. A segment's cells are looked at once, for both whether it touches
    them and how near it comes, so a line's rows stay where the line is.
    """
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    before = F.sum("length").over(Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    s = segments.select("id", "seq", *SEGMENT, length.alias("length"))
    s = s.withColumn("begin", F.coalesce(before, F.lit(0.0)))
    near = _spanned(s, size, ("ax", "bx"), ("ay", "by"), 1)
    mx, my = (F.col("_col") + 0.5) * size, (F.col("_row") + 0.5) * size
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along: Column = ((mx - F.col("ax")) * dx + (my - F.col("ay")) * dy) / (F.col("length") * F.col("length"))
    t = F.when(F.col("length") > 0, F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    near = near.withColumn("t", t)
    far = lambda m, a, d: m - F.col(a) - F.col("t") * d
    d2 = far(mx, "ax", dx) * far(mx, "ax", dx) + far(my, "ay", dy) * far(my, "ay", dy)
    chainage = F.round(F.col("begin") + F.col("t") * F.col("length"), 6)
    # one struct, opened: the condition then reads its fields, not all that they are made of
    near = near.select("id", "_row", "_col", "seq", F.inline(F.array(F.struct(F.round(d2, 9).alias("d2"), chainage.alias("chainage"), _touches(size).alias("_on")))))
    near = near.where(F.col("_on") | (F.col("d2") <= 0.51 * size * size))
    best = near.groupBy("id", "_row", "_col").agg(F.min(F.struct("d2", "seq", "chainage")).alias("b"), F.bool_or("_on").alias("_on"))
    out = best.where("_on").select("id", F.col("_row").alias("row"), F.col("_col").alias("col"), "b.chainage")
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("chainage", "row", "col")))
