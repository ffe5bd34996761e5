"""Connected components of a table of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links of a partition while they are worked on.
PER_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node reaches: node, root. `links`: a, b, long.

    Alternating stars: each node hands its larger neighbours to its smallest one (or itself), then its smaller ones too,
    until a round changes nothing: no link leads to a node that has a smaller neighbour, and no node has two.
    Links are combined into a minimum per task before they are moved; the rounds grow with the logarithm of the longest chain.
    Each half of a round is written, so that plans stay short. Null ends and loops are left out.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    parts = -(-edges.count() // PER_TASK) or 1
    edges = edges.coalesce(parts)  # few links in many partitions would cost more files than rows, round after round
    # With several parts, grouped by more than the join's key: the join then moves both sides itself, and Spark can split what
    # belongs to a node with very many links.
    by = ["hi", (F.col("hi") % 2).alias("_z")] if parts > 1 else ["hi"]
    more = True
    while more:
        least = edges.groupBy(*by).agg(F.min("lo").alias("m")).select(F.col("hi").alias("_lo"), "m")
        large = edges.join(least, F.col("lo") == F.col("_lo"), "left")
        large = large.select("hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved"))
        large = saved(large.groupBy("hi", "lo").agg(F.max("moved").alias("moved")).coalesce(parts))
        down = large.groupBy(*by).agg(F.min("lo").alias("m"), F.max("moved").alias("moved")).select("hi", "m", "moved")
        small = large.select("hi", "lo").join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("more"))
        both = small.unionByName(down.select("hi", F.col("m").alias("lo"), F.col("moved").alias("more")))
        both = saved(both.groupBy("hi", "lo").agg(F.max("more").alias("more")).coalesce(parts))
        edges, more = both.select("hi", "lo"), both.agg(F.max("more")).first()[0]
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    tops = roots.select(F.col("root").alias("node"), "root").distinct()
    return saved(roots.unionByName(tops).coalesce(parts))
