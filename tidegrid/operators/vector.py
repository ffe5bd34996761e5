"""Polygons, lines and profiles on the grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import saved


#: Edges of a polygon in a cell that are tested together; edges in cells up to which the table of cells is broadcast.
TOGETHER, FEW = 2000, 200_000


def _cell(v: str | Column, size: float) -> Column:
    """Cell of a coordinate, so that cell * size <= v < (cell + 1) * size also where the division rounds."""
    v = F.col(v) if isinstance(v, str) else v
    at = F.floor(v / size)
    return at - (v < at * size).cast("long") + (v >= (at + 1) * size).cast("long")


def grid_of(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """The cells of `size` inside polygons, as (id, r, c); and those that edges touch, as (id, r, c, chunk, chunks, k, inner, e): edges in
    parts of TOGETHER, each (x1, y1, x2, y2, g1, g2), k, what to start counting with, and how many cells right of it are inside.

    A point is inside if a ray to the right crosses an odd number of edges: those with (y1 > y) <> (y2 > y) and x < the edge's x at y.
    In a cell, the ray's parity is that of the cell's lower right corner, corrected by the edges that touch the cell: going from the
    corner up to the point's height, then left to the point, each of them changes sides as often as its ends and its x at both
    heights tell. Ends between these heights count in the two edges that meet there, so the result is that of the whole ray. g1
    and g2 say whether an end is above the corner and to its right. No edge touches the cells up to the next that one does, so these
    are inside if the corner is.

    A row of a polygon is in one task, without a join: edges are dealt out before they are spread over rows, then gathered by row.
    """
    eps = size * 1e-6  # an edge this near touches a cell: more are listed than must be
    x_at = lambda t: (F.col("x2") - F.col("x1")) * (t - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    dealt = edges.select("id", "x1", "y1", "x2", "y2").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x1", "y1", "x2", "y2")
    rows = dealt.withColumn("r", F.explode(F.sequence(F.floor((low - eps) / size), F.floor((high + eps) / size)))).repartition("id", "r")
    rows = rows.withColumn("y0", F.col("r") * F.lit(float(size)))
    flat = F.col("y1") == F.col("y2")
    within = lambda x: F.least(F.greatest(x, F.least("x1", "x2")), F.greatest("x1", "x2"))
    xa = F.when(flat, F.col("x1")).otherwise(within(x_at(F.greatest(low, F.col("y0") - eps))))
    xb = F.when(flat, F.col("x2")).otherwise(within(x_at(F.least(high, F.col("y0") + size + eps))))
    spans = (F.col("y1") > F.col("y0")) != (F.col("y2") > F.col("y0"))
    rows = rows.withColumns({"xa": xa, "xb": xb, "x0": F.when(spans, x_at(F.col("y0")))})
    cut = rows.withColumn("c", F.explode(F.sequence(F.floor((F.least("xa", "xb") - eps) / size), F.floor((F.greatest("xa", "xb") + eps) / size))))
    left, right = (F.col("c") * F.lit(float(size))), (F.col("c") + 1) * F.lit(float(size))
    above = lambda x, y: (F.col(y) > F.col("y0")) & (F.col(x) > right)
    number = lambda on: F.coalesce(on.cast("long"), F.lit(0))
    cut = cut.withColumns({"g1": above("x1", "y1"), "g2": above("x2", "y2"), "a0": number(right < F.col("x0")), "x_in": number((left < F.col("x0")) & (F.col("x0") <= right))})
    nth = F.row_number().over(Window.partitionBy("id", "r", "c").orderBy("x1", "y1", "x2", "y2"))
    cut = cut.withColumn("chunk", F.floor((nth - 1) / TOGETHER))
    cut = cut.groupBy("id", "r", "c", "chunk").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "g1", "g2")).alias("e"), F.sum("a0").alias("a0"), F.sum("x_in").alias("x_in"))
    # parity of the corners: edges that cross a row's lower line further right; each does so in a cell that it touches
    row = Window.partitionBy("id", "r").orderBy(F.desc("c"))
    further = row.rangeBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumns({"corner": F.coalesce(F.sum("x_in").over(further), F.lit(0)), "next": F.min("c").over(further), "chunks": F.count(F.lit(1)).over(row.rangeBetween(0, 0))})
    first = F.col("chunk") == 0
    k = F.when(first, F.col("corner")).otherwise(0) + F.col("a0")
    inner = F.when(first & (F.col("corner") % 2 == 1), F.col("next") - F.col("c") - 1)
    cut = saved(cut.select("id", "r", "c", "chunk", "chunks", k.alias("k"), F.coalesce(inner, F.lit(0)).alias("inner"), "e"))
    full = cut.where("inner > 0").select("id", "r", F.explode(F.expr("sequence(c + 1, c + inner)")).alias("c"))
    return full, cut


def inside(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """The points (x, y) inside polygons, as (id, and the points' columns), by the crossings of a ray to the right.

    `edges`: id, x1, y1, x2, y2 of closed rings. Points meet the cells of grid_of() by their own cell: in a cell inside a polygon nothing
    is tested, in one that edges touch only those edges are. Each row is a point; points without a place are in none.
    """
    full, cut = grid_of(edges, size)
    many = cut.agg(F.sum(F.size("e") + F.col("inner")), F.max("chunks")).first()
    # Spark takes these tables to be as small as that of the edges: without a hint it would broadcast them whatever their size
    hint = F.broadcast if (many[0] or 0) <= FEW else (lambda df: df.hint("merge"))
    p = points.withColumns({"_r": _cell("y", size), "_c": _cell("x", size)})
    names = [F.col(c) for c in points.columns]
    cells = lambda df: hint(df.withColumnsRenamed({"id": "_id", "r": "_r", "c": "_c"}))
    found = p.join(cells(full), ["_r", "_c"]).select(F.col("_id").alias("id"), *names)
    # how often edges change sides between the corner and the point
    turn = lambda e: f"""CASE WHEN ({e}.y1 > y) <> ({e}.y2 > y) AND x < ({e}.x2 - {e}.x1) * (y - {e}.y1) / ({e}.y2 - {e}.y1) + {e}.x1 THEN 1 ELSE 0 END
      + CASE WHEN {e}.g1 AND {e}.y1 <= y THEN 1 ELSE 0 END + CASE WHEN {e}.g2 AND {e}.y2 <= y THEN 1 ELSE 0 END"""  # noqa: E731
    turns = f"(CASE WHEN size(e) = 1 THEN k + {turn('e[0]')} ELSE aggregate(e, k, (s, d) -> s + {turn('d')}) END)"
    near = p.join(cells(cut.where("chunks = 1").select("id", "r", "c", "k", "e")), ["_r", "_c"])
    found = found.unionByName(near.where(f"{turns} % 2 = 1").select(F.col("_id").alias("id"), *names))
    if (many[1] or 0) > 1:  # cells with very many edges: counted part by part
        crowded = cut.where("chunks > 1")
        of = crowded.select(F.col("r").alias("_r"), F.col("c").alias("_c")).distinct()
        some = saved(p.join(hint(of), ["_r", "_c"], "left_semi").withColumn("_point", F.monotonically_increasing_id()))  # written: the numbers stay
        parts = some.join(cells(crowded.select("id", "r", "c", "k", "e")), ["_r", "_c"]).select("_point", "_id", F.expr(turns).alias("_n"))
        odd = parts.groupBy("_point", "_id").agg(F.sum("_n").alias("_n")).where("_n % 2 = 1")
        found = found.unionByName(some.join(odd.hint("merge"), "_point").select(F.col("_id").alias("id"), *names))
    return found


def edges(vertices: DataFrame) -> DataFrame:
    """id, x1, y1, x2, y2 of rings given as vertices (id, seq, x, y), closed."""
    w = Window.partitionBy("id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), to("x").alias("x2"), to("y").alias("y2"))


def areas(vertices: DataFrame) -> DataFrame:
    """Area of each ring, by the shoelace rule."""
    e = edges(vertices)
    return e.groupBy("id").agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))


def clip_limits(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column]:
    """Where segments (ax, ay, bx, by) enter and leave a box, as shares of their length, by Liang and Barsky's limits, and whether they do."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    lows, highs, ok = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for d, a, lo, hi in ((dx, F.col("ax"), x0, x1), (dy, F.col("ay"), y0, y1)):
        s, e = F.when(d != 0, (lo - a) / d), F.when(d != 0, (hi - a) / d)
        lows.append(F.coalesce(F.least(s, e), F.lit(0.0)))
        highs.append(F.coalesce(F.greatest(s, e), F.lit(1.0)))
        ok = ok & ((d != 0) | a.between(lo, hi))
    return F.greatest(*lows), F.least(*highs), ok & (F.greatest(*lows) <= F.least(*highs))


def clipped(segments: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """Segments (ax, ay, bx, by) cut to a box; those outside go."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t0, t1, ok = clip_limits(*map(F.col, (x0, y0, x1, y1)))
    out = segments.withColumns({"t0": t0, "t1": t1}).where(ok)
    x, y = (lambda t: F.col("ax") + F.col(t) * dx), (lambda t: F.col("ay") + F.col(t) * dy)
    return out.withColumns({"cx": x("t0"), "cy": y("t0"), "dx": x("t1"), "dy": y("t1")})


def profile(lines: DataFrame, n: int) -> DataFrame:
    """Pixels along lines (id, r1, c1, r2, c2): n places each, evenly, cut to whole pixels: id, i, row, col."""
    t = F.col("i") / (n - 1)
    at = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * t).cast("int")
    i = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return i.select("id", "i", at("r1", "r2").alias("row"), at("c1", "c2").alias("col"))


def line_cells(segments: DataFrame, per_pixel: int = 4) -> DataFrame:
    """id, row, col: pixels under segments (id, ax, ay, bx, by in pixels), from `per_pixel` places a pixel of length."""
    n = F.greatest(F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) * per_pixel), F.lit(1)).cast("int")
    at = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    place = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") / F.col("_n"))).cast("int")
    return at.select("id", place("ay", "by").alias("row"), place("ax", "bx").alias("col")).distinct()


def hull(points: DataFrame, key: str, group: int = 500) -> DataFrame:
    """Vertices (key, seq, x, y) of the convex hull of each key's points, counter-clockwise from the left.

    A vertex of the hull is one of the hull of any group that holds it: first of a key's points that lie side by side in the input,
    so that few points are shuffled; then points are dealt to groups of about `group`, the hulls of these dealt anew, until a key has
    one group. No array outgrows a group or a batch.
    """
    points = saved(_hulls_of_batches(points.select(key, F.col("x").cast("double"), F.col("y").cast("double")).where("x IS NOT NULL AND y IS NOT NULL"), key).distinct())
    most = points.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while True:
        parts = -(-most // group)
        at = F.pmod(F.xxhash64("x", "y", F.lit(parts)), F.lit(max(1, parts)))
        sets = points.groupBy(key, at.alias("_g")).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("ps"))
        sets = sets.withColumns({"lo": F.expr(_chain("ps", ">")), "hi": F.expr(_chain("ps", "<"))})
        if parts <= 1:
            ring = F.expr("concat(lo, slice(reverse(hi), 2, greatest(size(hi) - 2, 0)))")
            return sets.select(key, F.posexplode(ring).alias("seq", "p")).select(key, "seq", "p.x", "p.y")
        points = sets.select(key, F.explode(F.expr("array_union(lo, hi)")).alias("p")).select(key, "p.x", "p.y")
        most = parts * 40 if parts > 1 else 0
        most = min(most, parts * group // 2)


def _hulls_of_batches(points: DataFrame, key: str) -> DataFrame:
    """The vertices of the hulls of each key's points within a batch of rows."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = pc.fill_null(batch.column(key).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            at = np.lexsort((y, x, code))
            # of the points of one x only the lowest and the highest can be vertices
            new = (np.diff(code[at]) != 0) | (np.diff(x[at]) != 0)
            at = at[np.r_[True, new] | np.r_[new, True]]
            kept: list[int] = []
            for part in np.split(at, np.flatnonzero(np.diff(code[at])) + 1):
                xs, ys, rows = x[part].tolist(), y[part].tolist(), part.tolist()
                kept += [rows[i] for i in {*_turns(xs, ys, 1), *_turns(xs, ys, -1)}]
            yield batch.take(pa.array(kept, pa.int64()))

    return points.mapInArrow(mapped, points.schema)


def _turns(xs: list[float], ys: list[float], sign: int) -> list[int]:
    """The places of the points of the lower (1) or upper (-1) chain of a hull; points are sorted."""
    chain: list[int] = []
    for i, (x, y) in enumerate(zip(xs, ys)):
        while len(chain) > 1:
            o, a = chain[-2], chain[-1]
            if sign * ((xs[a] - xs[o]) * (y - ys[o]) - (ys[a] - ys[o]) * (x - xs[o])) > 0:
                break
            chain.pop()
        chain.append(i)
    return chain


def _chain(ps: str, turn: str) -> str:
    """SQL of one chain of a hull: a fold over sorted points that drops the last ones while the turn is wrong."""
    o, a = "element_at(s, -2)", "element_at(s, -1)"
    cross = f"({a}.x - {o}.x) * (p.y - {o}.y) - ({a}.y - {o}.y) * (p.x - {o}.x)"
    pop = f"aggregate(sequence(1, size(c)), c, (s, k) -> CASE WHEN size(s) >= 2 AND NOT ({cross} {turn} 0) THEN slice(s, 1, size(s) - 1) ELSE s END)"
    kind = "array<struct<x:double,y:double>>"
    return f"aggregate({ps}, CAST(array() AS {kind}), (c, p) -> CASE WHEN size(c) < 2 THEN concat(c, array(p)) ELSE concat({pop}, array(p)) END)"
