"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Every document of a source gets the same expected number of copies, target / source size. The whole
part is taken as it is; the fractional parts, measured in words, are rounded in pairs: mass moves at
random from one document to the other until one of them is whole, so that the words of the pair are
kept and the expected copies of each too. Blocks of about `BLOCK` documents leave one fractional
document each; these meet again in blocks, level by level, until a source has one left, which is rounded
to the nearer side. A source is therefore off its target by half a document at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import aside, numbered, repeated, saved, small, table

BLOCK = 128
WORD = "[^\\x20\\x09-\\x0D]+"
UNIT = ("key", "doc_id", "source", "size", "n", "whole", "mass")


def word_count(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Targets of `sources` (source, source_size): shares of the total by weight, at most `most` times the size.

    Weights repeat over the sources in code-point order, null last. What a source can't take goes to the
    others by weight until none is above its limit: with sources in the order of limit / weight, the level
    is that of the first source which, with all before it at their limits, isn't above its own. The table
    has a row per source, so its windows are over source names, not over documents.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("weight", pick.cast("double"))
        .withColumn("room", F.col("source_size") * most)
        .withColumn("ratio", F.col("room") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
        .select("source", "source_size", F.least("room", F.col("level") * F.col("weight")).alias("target"))
    )


def _rounded(seed: int) -> Column:
    """Fold a block's units into those that became whole and at most one that didn't."""
    unit = lambda x, mass=None: "named_struct(" + ", ".join(f"'{k}', {mass if k == 'mass' and mass else f'{x}.{k}'}" for k in UNIT) + ")"
    state = lambda cur, *done: f"named_struct('cur', {cur}, 'done', concat(s.done, array({', '.join(done)})))"
    up, down = (lambda x: unit(x, f"CAST({x}.size * 1.0D AS DOUBLE)")), (lambda x: unit(x, "0.0D"))
    a, e = "s.cur", "e"
    give, take = f"least({a}.mass, {e}.size - {e}.mass)", f"least({a}.size - {a}.mass, {e}.mass)"
    coin = f"(pmod(xxhash64({seed}, {a}.key, {e}.key), 1073741824L) + 0.5D) / 1073741824D"
    step = f"""(s, e) -> CASE
      WHEN {a} IS NULL THEN named_struct('cur', {unit(e)}, 'done', s.done)
      WHEN {a}.mass <= 0 OR {a}.mass >= {a}.size THEN {state(unit(e), unit(a))}
      WHEN {coin} * ({give} + {take}) < {take} THEN CASE
        WHEN {a}.mass <= {e}.size - {e}.mass THEN {state(unit(e, f"({e}.mass + {a}.mass)"), down(a))}
        ELSE {state(unit(a, f"({a}.mass - ({e}.size - {e}.mass))"), up(e))} END
      ELSE CASE
        WHEN {a}.size - {a}.mass <= {e}.mass THEN {state(unit(e, f"({e}.mass - ({a}.size - {a}.mass))"), up(a))}
        ELSE {state(unit(a, f"({a}.mass + {e}.mass)"), down(e))} END
      END"""
    kind = "struct<key:bigint,doc_id:bigint,source:string,size:bigint,n:bigint,whole:bigint,mass:double>"
    return F.expr(f"aggregate(units, named_struct('cur', CAST(NULL AS {kind}), 'done', CAST(array() AS array<{kind}>)), {step})")


def copies(sizes: DataFrame, targets: DataFrame, n_sources: int, seed: int = 7) -> DataFrame:
    """Total copies of each group of alike rows: doc_id, source, size, n (its rows), copies, source_size, target.

    `sizes`: doc_id long, source, size, n, a row per distinct doc_id, source and size; `targets`: of
    source_targets(). Rows alike in all three share their copies: none gets more than one more than another.
    """
    targets = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    each = sizes.join(small(targets, n_sources), same).drop("_source")
    want = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    each = each.withColumn("whole", F.floor(want)).withColumn("mass", (want - F.col("whole")) * F.col("size"))
    each = each.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    done = [each.where(~open_).select(*UNIT)]
    left = each.where(open_).withColumn("room", F.ceil(F.col("n_docs") / BLOCK))
    most = each.agg(F.max("n_docs")).first()[0] or 0
    for level in range(max(1, math.ceil(math.log(max(most, 2), BLOCK)))):
        block = F.pmod(F.xxhash64(F.lit(level), F.lit(seed), "key"), F.greatest("room", F.lit(1)))
        blocks = left.groupBy("source", "room", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*UNIT))).alias("units"))
        blocks = saved(blocks.select("room", _rounded(seed + level).alias("r")))
        done.append(blocks.select(F.explode("r.done").alias("u")).select("u.*"))
        left = blocks.where("r.cur IS NOT NULL").select(F.ceil(F.col("room") / BLOCK).alias("room"), "r.cur.*")
    last = F.when(F.col("mass") * 2 >= F.col("size"), F.col("size").cast("double")).otherwise(0.0)
    done.append(left.withColumn("mass", last).select(*UNIT))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("copies", F.col("whole") + F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0))
    return out.join(small(targets, n_sources), same).select("doc_id", "source", "size", "n", "copies", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """How often the mix takes each document; one row per distinct doc_id, source and size, see copies().

    Null text has size 0 and is never taken; a null source is a source of its own, last in order. A null
    doc_id is a value like any other. Equal rows are counted together, so ties and repeats are exact. An
    empty table gives an empty result. Only doc_id, text and source are read.
    """
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    sizes = saved(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = saved(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    found = source_targets(sources.select("source", "source_size"), weights, most)
    found = saved(found.join(sources.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    return copies(sizes, found, found.count(), seed)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    docs, back = aside(docs, "doc_id", "text", "source")
    plan = saved(mix(docs, **how)).withColumn("_k", F.xxhash64("doc_id", "source", "size"))
    keys = {"_d": F.col("doc_id").cast("long"), "_s": F.col("source").cast("string"), "_n": word_count("text")}
    rows = docs.withColumns(keys).withColumn("_k", F.xxhash64("_d", "_s", "_n"))
    plan = plan.select("_k", *(F.col(c).alias(f"_p_{c}") for c in ("doc_id", "source", "size", "n", "copies")))
    same = (rows._d.eqNullSafe(plan._p_doc_id)) & (rows._s.eqNullSafe(plan._p_source)) & (rows._n == plan._p_size)
    both = rows.join(plan, (rows._k == plan._k) & same).drop(plan._k)
    # rows alike whose copies don't divide evenly are numbered; nearly all rows stand alone and aren't
    odd = F.col("_p_copies") % F.col("_p_n") > 0
    even = both.where(~odd).withColumn("_times", F.floor(F.col("_p_copies") / F.col("_p_n")).cast("long"))
    if plan.where(F.col("_p_copies") % F.col("_p_n") > 0).limit(1).count():
        some = numbered(both.where(odd).withColumn("_key", F.struct("_d", "_s", "_n")), ["_key"]).drop("_key")
        times = F.floor(F.col("_p_copies") / F.col("_p_n")) + F.when(F.col("_nth") <= F.col("_p_copies") % F.col("_p_n"), 1).otherwise(0)
        even = even.unionByName(some.withColumn("_times", times.cast("long")).drop("_nth"))
    return repeated(even.where("_times > 0"), "_times").select(*back.values())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the words that the mix takes of it."""
    found = repeated(mix(table(spark, sf_dir, "documents")), "n")
    times = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("_i") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    return found.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))
