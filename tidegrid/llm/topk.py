"""Exact top-k by integer inner product, by distributed histogram selection.

Every query is scored against every candidate, tile by tile. A pass counts each query's scores in RANGES equal ranges of the
interval that holds its k-th largest one; the counts of all tiles, added, tell the range it is in, which is the interval of the
next pass, until the interval is a single score. A last pass keeps what reaches it, and ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table

#: Rows of a tile's sides; ranges of a pass; rows of queries scored at once.
QUERIES, CANDIDATES, RANGES, ROWS = 4096, 8192, 4096, 256
#: Scores beyond it count as it.
MOST = 1 << 60


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact up to MOST. Doubles hold those of rows with norms below 2^26 exactly; the
    others are multiplied as Python's numbers."""
    x, y = q.astype(np.float64), c.astype(np.float64)
    wide_q, wide_c = (np.flatnonzero(np.linalg.norm(m, axis=1) >= 1 << 26) for m in (x, y))
    x[wide_q], y[wide_c] = 0, 0
    out = (x @ y.T).astype(np.int64)
    if len(wide_q):
        out[wide_q] = np.clip(q[wide_q].astype(object) @ c.T.astype(object), -MOST, MOST).astype(np.int64)
    if len(wide_c):
        out[:, wide_c] = np.clip(q.astype(object) @ c[wide_c].T.astype(object), -MOST, MOST).astype(np.int64)
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def range_counts(s: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray, keep: np.ndarray, ranges: int = RANGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, range and count of the scores of each row from its `low` to its `high`, highest ranges first, as far as they hold `need`
    scores: the k-th largest of all can't be in a lower one. `keep` is false where a row meets itself."""
    width = (high - low) // ranges + 1
    row, col = np.nonzero(keep & (s >= low[:, None]) & (s <= high[:, None]))
    at = row * ranges + (ranges - 1 - (s[row, col] - low[row]) // width[row])
    name, n = np.unique(at, return_counts=True)
    row = name // ranges
    before = np.cumsum(n) - n
    first = np.searchsorted(row, row)  # place of the row's highest range
    use = before - before[first] < need[row]
    return row[use], ranges - 1 - name[use] % ranges, n[use]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, ranges: int = RANGES) -> DataFrame:
    """query_id, rank from 1, vec_id, score, query: for each query row the k other rows with the largest scores.

    `vectors`: vec_id long, embedding; `is_query` picks the queries. Components become floor(scale * x), x as a double; a
    score is the inner product of these whole numbers, and beyond 2^60 counts as that. Ties go to the smaller vec_id. Each row
    is a candidate of its own for every query but itself, also where rows share a vec_id; `query` numbers the query rows. Rows
    without vec_id and vectors that are null or hold null or non-finite components take no part; zero vectors do, and vectors
    meet only those of their length. Queries with fewer than k others get all. An empty table gives an empty result; other
    columns aren't read.

    Both sides are dealt to blocks by a hash; a tile, one block of each, returns at most k counts or k rows a query, so what
    is moved besides the vectors is k x queries x blocks. Only queries whose k-th score isn't known yet are scored again.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = saved(rows.select("*", F.size("x").alias("dim"), F.monotonically_increasing_id().alias("row")))  # written: the numbers stay
    n_q, n_c, most = rows.agg(F.count(F.when(F.col("asks"), 1)), F.count(F.lit(1)), F.max(F.expr("aggregate(x, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)"))).first()
    n_q, n_c = max(1, -(-n_q // QUERIES)), max(1, -(-n_c // CANDIDATES))
    bound = int(min(MOST, (most or 0) * (1 + 1e-9) + 1))  # no score is larger: |q| |c| <= max |x|^2
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("dim", "row", "vec_id", "x", every(n_q).alias("i"), block(n_c).alias("j"))
    queries = rows.where("asks").select(F.col("dim").alias("q_dim"), F.col("row").alias("q_row"), F.col("x").alias("q"), block(n_q).alias("i"))

    def tiles(state: DataFrame, step, schema: str) -> DataFrame:
        asked = state.join(queries, F.col("row") == F.col("q_row")).select("*", every(n_c).alias("j"))

        def tile(a: pa.Table, b: pa.Table) -> pa.Table:
            found = []
            if len(a) and len(b):
                q, c = _matrix(a.column("q"), len(a)), _matrix(b.column("x"), len(b))
                own, low, high, need = (a.column(n).to_numpy() for n in ("row", "low", "high", "need"))
                ids, other = b.column("vec_id").to_numpy(), b.column("row").to_numpy()
                for at in range(0, len(q), ROWS):
                    p = slice(at, at + ROWS)
                    found.append(step(scores(q[p], c), own[p], low[p], high[p], need[p], own[p, None] != other[None], ids))
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.table({n: pa.array(np.concatenate([f[i] for f in found]) if found else [], pa.int64()) for i, n in enumerate(names)})

        return asked.groupBy("q_dim", "i", "j").cogroup(candidates.groupBy("dim", "i", "j")).applyInArrow(tile, schema)

    def counted(s, own, low, high, need, keep, ids):
        row, at, n = range_counts(s, low, high, need, keep, ranges)
        return own[row], at, n

    def reaching(s, own, low, high, need, keep, ids):
        row, col = np.nonzero(keep & (s >= low[:, None]))
        order = np.lexsort((ids[col], -s[row, col], row))
        row, col = row[order], col[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k  # ties may be very many; k of a tile are enough
        return own[row[best]], ids[col[best]], s[row[best], col[best]]

    state = saved(queries.select(F.col("q_row").alias("row"), F.lit(-bound).alias("low"), F.lit(bound).alias("high"), F.lit(k).cast("long").alias("need")))
    done = []
    while True:
        open_ = state.where("low < high")
        done.append(state.where("low >= high"))
        if not open_.limit(1).count():
            break
        counts = tiles(open_, counted, "row long, at long, n long").groupBy("row", "at").agg(F.sum("n").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("at")))
        # the highest range by which `need` scores are reached
        hit = counts.withColumn("so_far", so_far).join(open_, "row").where("so_far >= need AND so_far - n < need")
        hit = hit.withColumn("width", F.expr(f"(high - low) div {ranges} + 1"))
        found = hit.select("row", F.expr("low + at * width").alias("low"), F.expr("least(high, low + (at + 1) * width - 1)").alias("high"), F.expr("need - (so_far - n)").alias("need"))
        # with fewer than `need` candidates in all, everything reaches the lowest score
        few = open_.join(hit.select("row"), "row", "left_anti").select("row", "low", F.col("low").alias("high"), "need")
        state = saved(found.unionByName(few))
    state = done[0]
    for more in done[1:]:
        state = state.unionByName(more)
    best = tiles(state, reaching, "row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = rows.where("asks").select("row", F.col("vec_id").alias("query_id"))
    return best.join(ids, "row").select("query_id", "rank", "vec_id", "score", F.col("row").alias("query"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("query")


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
