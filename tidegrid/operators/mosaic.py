"""The whole map: regions over all tiles, exact distances to data, and filling from the nearest. No task holds more than a tile, a row
or a column of the map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import components4
from .labels import saved

#: Pixels along a tile's side; what row and col make up a pixel's number by.
SIDE, STRIDE = 256, 1 << 32


def smallest_reached(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches. `links`: a, b, long.

    Rounds of stars: each node hands its larger neighbours on to the smallest it knows, then its smaller ones too, until every node
    is linked to one smaller node that has none itself. A chain is halved by each round, at least.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
        # a node's smallest neighbour, or itself, for each larger neighbour
        up = edges.join(least.withColumnRenamed("hi", "lo"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        down = up.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = up.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = saved(joined.unionByName(down.select("hi", F.col("m").alias("lo"))).distinct())
        about = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hi").alias("nodes")).first()
        if about.n == about.nodes and not edges.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count():
            tops = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(tops)


def regions(cells: DataFrame, side: int = SIDE, keys: tuple[str, ...] = ()) -> DataFrame:
    """`cells` (keys, row, col; not negative) with region: row * 2^32 + col of the first pixel of its 4-connected region on the map.

    Tiles of `side` pixels are labelled by themselves. Only pixels at their borders meet, which tells what regions of neighbouring
    tiles are one; the smallest of those linked names them all. With `keys`, each is a map of its own.
    """
    names, kinds = [*keys, "row", "col"], dict(cells.dtypes)
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    tiles = cells.select(*names).withColumns({"_r": at("row"), "_c": at("col")})

    def labelled(t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        mask = np.zeros((side, side), bool)
        y, x = row % side, col % side
        mask[y, x] = True
        first = components4(mask)[y, x]
        label = (first // side + row - y) * STRIDE + first % side + col - x
        return t.select(names).append_column("label", pa.array(label))

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", label long"
    found = saved(tiles.groupBy(*keys, "_r", "_c").applyInArrow(labelled, schema))
    links = None
    for c in ("row", "col"):
        last = found.where(F.col(c) % side == side - 1).withColumn(c, F.col(c) + 1).withColumnRenamed("label", "a")
        first = found.where(F.col(c) % side == 0).withColumnRenamed("label", "b")
        both = last.join(first, names).select(*keys, "a", "b").distinct()
        links = both if links is None else links.unionByName(both)
    if keys:  # regions are numbered over all maps for the rounds
        numbers = saved(found.select(*keys, "label").distinct().withColumn("id", F.monotonically_increasing_id()))
        for side_ in "ab":
            links = links.join(numbers.select(*keys, F.col("label").alias(side_), F.col("id").alias(f"{side_}_id")), [*keys, side_])
        roots = smallest_reached(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        roots = numbers.join(roots, F.col("id") == F.col("node")).select(*keys, "label", "root")
        least = roots.groupBy("root").agg(F.min("label").alias("region"))
        roots = roots.join(least, "root").select(*keys, "label", "region")
    else:
        roots = smallest_reached(links).select(F.col("node").alias("label"), F.col("root").alias("region"))
    out = found.join(roots.hint("merge"), [*keys, "label"], "left")  # as many as there are borders: never through the driver
    return out.select(*names, F.coalesce("region", "label").alias("region"))


def region_sizes(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return found.groupBy(*keys, "region").agg(F.count(F.lit(1)).alias("size"))


def lower_envelope(rows: np.ndarray, heights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place of `at` the index of the row with the least (at - row)^2 + height, ties to the first; whole numbers, rows sorted.

    A row's parabola is the lowest from one place on, until that of a later row is: a stack of rows and the places they begin at.
    """
    stack: list[int] = []
    begins: list[int] = []
    r, h = rows.tolist(), heights.tolist()
    for b in range(len(r)):
        begin = None
        while stack:
            a = stack[-1]
            begin = (r[b] * r[b] + h[b] - r[a] * r[a] - h[a]) // (2 * (r[b] - r[a])) + 1
            if len(stack) > 1 and begin <= begins[-1]:
                stack.pop()
                begins.pop()
            else:
                break
        if stack and len(stack) == 1 and begin is not None and begin <= at[0]:
            stack.pop()  # the first one is never the lowest
            begins.pop()
        begins.append(begin if stack else int(at[0]))
        stack.append(b)
    return np.array(stack, np.int64)[np.searchsorted(np.array(begins), at, side="right") - 1]


def nearest_values(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row, col, v, d2, near_row, near_col, near: the squared distance in pixels from each pixel to the nearest one with a value, its
    place and value; ties go to the smaller row, then column. NULL where a map has no value. `cells`: every pixel of the map, v NULL
    where it has none.

    Exact, in two passes: along rows the nearest value to either side; then, in each column, the lowest of the parabolas that the
    rows' distances make.
    """
    rows = Window.partitionBy(*keys, "row").orderBy("col")
    own = F.when(F.col("v").isNotNull(), F.struct(F.col("col").alias("c"), "v"))
    before = F.last(own, True).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(own, True).over(rows.rowsBetween(0, Window.unboundedFollowing))
    flat = cells.select(*keys, "row", "col", "v", before.alias("_b"), after.alias("_a"))
    left = F.col("_a").isNull() | (F.col("col") - F.col("_b.c") <= F.col("_a.c") - F.col("col"))
    pick = F.when(F.col("_b").isNotNull() & left, F.col("_b")).otherwise(F.col("_a"))
    flat = flat.select(*keys, "row", "col", "v", pick["c"].cast("long").alias("_c"), pick["v"].alias("_v"))
    kinds = dict(flat.dtypes)

    def column(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        row = t.column("row").to_numpy().astype(np.int64)
        some = t.filter(t.column("_c").is_valid())
        if not len(some):
            empty = pa.nulls(len(t), pa.int64())
            return pa.table({**{c: t.column(c) for c in (*keys, "row", "col", "v")}, "d2": empty, "near_row": empty, "near_col": empty, "near": pa.nulls(len(t), some.schema.field("_v").type)})
        y, x = some.column("row").to_numpy().astype(np.int64), some.column("_c").to_numpy()
        c = t.column("col")[0].as_py()
        best = lower_envelope(y, (x - c) ** 2, row)
        d2 = (row - y[best]) ** 2 + (x[best] - c) ** 2
        out = {"d2": pa.array(d2), "near_row": pa.array(y[best]), "near_col": pa.array(x[best]), "near": some.column("_v").take(pa.array(best))}
        return pa.table({**{c: t.column(c) for c in (*keys, "row", "col", "v")}, **out})

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "row", "col", "v")) + f", d2 long, near_row long, near_col long, near {kinds['_v']}"
    return flat.groupBy(*keys, "col").applyInArrow(column, schema)


def filled(cells: DataFrame, most: int | None = None, side: int = SIDE, keys: tuple[str, ...] = ()) -> DataFrame:
    """`cells` with the nearest value where there is none; with `most`, in 4-connected gaps of at most so many pixels only, wherever on
    the map they lie. Blocked pixels are values too."""
    near = nearest_values(cells, keys)
    fill: Column = F.coalesce("v", "near")
    if most is not None:
        gaps = regions(cells.where("v IS NULL"), side, keys)
        good = region_sizes(gaps, keys).where(F.col("size") <= most).select(*keys, "region")
        good = gaps.join(good, [*keys, "region"]).select(*keys, "row", "col", F.lit(True).alias("_fill"))
        near = near.join(good, [*keys, "row", "col"], "left")
        fill = F.when(F.col("v").isNull() & F.col("_fill"), F.col("near")).otherwise(F.col("v"))
    return near.select(*keys, "row", "col", fill.alias("v"))
