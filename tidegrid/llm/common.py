"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a table may be broadcast; larger ones take a shuffled join.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch of whole texts on its way to a Python worker.
BATCH_BYTES = 4 << 20
#: Rows that repeated() makes of a row at once.
REPEATS = 10_000
#: Parts that numbered() deals the rows of a key to.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` to the folder of spark.checkpoint.dir, which all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set, a temporary folder of a session with a local master, which has no other machine;
    on a cluster that would be lost on other machines, so it is an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder and not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="tidegrid-")


def bounded_batches(spark: SparkSession) -> None:
    """Let batches of whole texts hold BATCH_BYTES at most, or one row, whatever the texts' length; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def aside(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with all columns but `own` renamed by their place, other0 on, so that none clashes with an operator's inner ones; and, by
    name, what selects the columns back."""
    names = [c if c in own else f"other{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), {c: F.col(n).alias(c) for n, c in zip(names, df.columns)}


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row of `df` as often as its column `times` (long) says, with _i from 1. Rows that occur very often are dealt out in
    blocks first, so neither an array nor a task grows with the number."""
    few, many = df.where(F.col(times) <= REPEATS), df.where(F.col(times) > REPEATS)
    few = few.withColumn("_i", F.explode(F.expr(f"CASE WHEN {times} > 0 THEN sequence(1L, {times}) END")))
    many = many.withColumn("_b", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {REPEATS})")))
    many = many.repartition(F.xxhash64("_b", *df.columns))
    many = many.withColumn("_i", F.explode(F.expr(f"sequence(_b * {REPEATS} + 1, least({times}, (_b + 1) * {REPEATS}))"))).drop("_b")
    return few.unionByName(many)


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with _nth: a number from 1 of each row among those with its keys (not null), whatever their order.

    The rows of a key are dealt to parts and numbered there, then moved on by the counts of the parts before, so a key that
    very many rows share isn't numbered in one task. The rows are written first: a repeated task meets the same ones.
    """
    rows = saved(df.withColumn("_id", F.monotonically_increasing_id())).withColumn("_salt", F.col("_id") % SALTS)
    counts = rows.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_id")))
    rows = rows.join(counts.select(*keys, "_salt", before.alias("_before")), [*keys, "_salt"])
    return rows.withColumn("_nth", F.col("_nth") + F.col("_before")).select(*df.columns, "_nth")


def forest(pairs, n: int) -> list[int]:
    """Which of the pairs (rows of two numbers below n) join two trees, so that the rest add nothing to what they reach."""
    parent, kept = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k, (i, j) in enumerate(pairs.tolist()):
        if (a := root(i)) != (b := root(j)):
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible uniform number in (0, 1) from the columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def valid_vector(v: str) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
