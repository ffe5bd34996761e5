"""Exact quantiles of many groups at once, without holding a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import saved

#: Ranges that an interval is counted in, and rows of the table of intervals up to which it is broadcast.
RANGES, FEW = 1024, 100_000


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Equal keys, nulls alike."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys), F.lit(True))


def ranked(values: DataFrame, ranks: DataFrame, keys: tuple[str, ...], ranges: int = RANGES) -> DataFrame:
    """_keys, rank, value: the value at each of `ranks` (_keys, rank from 0; low and high, the group's least and largest value), among a
    group's `values` (keys, v; finite, not null).

    A pass counts the values of each interval that holds a wanted one in equal ranges, whose least and largest values become the next
    intervals; ranks that share an interval share its counts. An interval of one value is done. A group sends `ranges` counts an
    interval at most, whatever its size. Every third pass has ranges of equal ratio, so values of very different sizes part soon.
    """
    # grows with v, by its sign and exponent
    size = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))
    places = [lambda c: F.col(c), lambda c: F.col(c), size]
    passes = 0
    names = [f"_{k}" for k in keys]
    left = ranks.select(*names, "rank", "low", "high", F.lit(0).cast("long").alias("below"))
    done = []
    while True:
        left = saved(left)
        done.append(left.where("low = high").select(*names, "rank", F.col("low").alias("value")))
        left = left.where("low < high")
        spans = saved(left.select(*names, "low", "high").distinct())
        n = spans.count()
        if not n:
            return reduce(DataFrame.unionByName, done)
        hint = F.broadcast if n <= FEW else (lambda df: df)
        on = places[passes % 3]
        at = F.floor((on("v") - on("low")) / (on("high") - on("low")) * ranges)
        at = F.least(F.coalesce(F.when(on("high") > on("low"), at), F.lit(0)), F.lit(ranges - 1))
        passes += 1
        counts = values.join(hint(spans), _same(values, spans, keys) & F.col("v").between(F.col("low"), F.col("high")))
        counts = counts.groupBy(*names, "low", "high", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("n").over(Window.partitionBy(*names, "low", "high").orderBy("at")) - F.col("n")
        counts = counts.withColumn("before", before).select(*(F.col(c).alias(f"_{c}") for c in names), F.col("low").alias("l"), F.col("high").alias("h"), "n", "a", "b", "before")
        hit = _same(left, counts, tuple(names)) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
        place = F.col("rank") - F.col("below")
        found = left.join(counts, hit & (place >= F.col("before")) & (place < F.col("before") + F.col("n")))
        left = found.select(*names, "rank", F.col("a").alias("low"), F.col("b").alias("high"), (F.col("below") + F.col("before")).alias("below"))


def quantiles(df: DataFrame, v: str, shares: tuple[float, ...], keys: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """keys, share, value: quantiles of column `v` by group, linear between the two nearest ranks, as percentile() has them. Values that
    are null or NaN don't count, groups without any other are left out; infinite ones aren't allowed."""
    values = saved(df.select(*keys, F.col(v).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    about = values.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    names = [f"_{k}" for k in keys]
    wanted = saved(about.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", F.col("share") * (F.col("n") - 1)))
    ends = wanted.select(*names, "low", "high", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    found = ranked(values, ends, keys, ranges)
    out = wanted.select(*names, "share", "place")
    for rank, name in ((F.floor("place"), "a"), (F.ceil("place"), "b")):
        side = found.select(*(F.col(c).alias(f"_{c}") for c in names), F.col("rank").alias("_rank"), F.col("value").alias(name))
        out = out.join(side, _same(out, side, tuple(names)) & (rank == F.col("_rank"))).select(*out.columns, name)
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b"))
    return out.select(*(F.col(f"_{k}").alias(k) for k in keys), "share", value.alias("value"))


def wide(found: DataFrame, keys: tuple[str, ...], names: dict[float, str]) -> DataFrame:
    """quantiles() with a column a share."""
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in names.items()))
