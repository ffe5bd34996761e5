"""Nearest neighbours by int8 tiles, and near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, saved, table, valid_vector
from .components import components

QUERIES, CANDIDATES = 4096, 8192
#: Query rows alike that one entry stands for at most.
COPIES = 1000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


# --- nearest neighbours -----------------------------------------------------------------------------


def _int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of -127 to 127, a scale a row, the norm of what they leave out, their own norm."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    near = np.rint(x / scale)
    return near.astype(np.float32), scale, np.linalg.norm(x - near * scale, axis=1), np.linalg.norm(near * scale, axis=1)


def tile_top(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, rows: int = 256, times: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of the candidates: (place of the query, ids, exact inner products).

    A candidate stands for `times` rows (1 each by default); a query is itself one of those alike in id and vector. Products of
    the int8 forms bound the true ones: by Cauchy-Schwarz they are off by no more than |q| |c - c8| + |q - q8| |c8|. Candidates
    whose upper bound is below the k-th largest lower bound can't be among the k nearest; the others are computed in double precision.
    """
    q8, qs, q_off, _ = _int8(q)
    c8, cs, c_off, c_norm = _int8(c)
    times = np.ones(len(c), np.int64) if times is None else times
    exact = q.shape[1] <= 1024  # sums of products of int8 fit a float32's 24 bits
    for at in range(0, len(q), rows):
        part = slice(at, at + rows)
        near = (q8[part] @ c8.T if exact else q8[part].astype(np.float64) @ c8.T.astype(np.float64)) * qs[part] * cs.T
        off = np.outer(np.linalg.norm(q[part], axis=1), c_off) + np.outer(q_off[part], c_norm)
        off += 1e-5 * (np.abs(near) + off) + 1e-300
        i, j = np.nonzero(q_ids[part, None] == c_ids[None, :])
        own = (q[at + i] == c[j]).all(axis=1)
        own = dict(zip(i[own].tolist(), j[own].tolist()))
        for i, j in own.items():
            if times[j] == 1:
                near[i, j] = -np.inf
        low = near - off
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        for i, cut in enumerate(least):
            found = np.flatnonzero((near[i] + off[i] >= cut) & np.isfinite(near[i]))
            # summed within each row, so that equal vectors score alike whatever their number
            score = np.concatenate([(c[found[j : j + 1024]] * q[at + i]).sum(axis=1) for j in range(0, max(1, len(found)), 1024)])
            best = np.lexsort((c_ids[found], -score))[:k]
            n = np.minimum(times[found[best]] - (found[best] == own.get(i, -1)), k)
            best = np.repeat(best, n)[:k]
            yield at + i, c_ids[found][best], score[best]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest candidates of each query by inner product: query_id, rank from 1, vec_id, score, query.

    Both tables: vec_id long, embedding. Each row of `queries` is a query, also where rows share a vec_id: `query` numbers them.
    Each row of `candidates` is a candidate, but for one alike in vec_id and embedding, which is the query itself; rows with its
    vec_id and another embedding, and further copies of it, are others. Ties go to the smaller vec_id. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without vec_id, take no part; vectors meet only those of their length.
    An empty table gives an empty result. Products beyond the range of doubles, and of vectors with no component above 1e-305, which
    single precision can't hold either, aren't found.

    Rows alike are computed once and counted. Queries and candidates are dealt to blocks by a hash, so that a tile is one block of
    each, and every tile returns at most k candidates a query. Work and rows moved follow queries x candidates.
    """

    def ready(df: DataFrame) -> DataFrame:
        df = df.where(valid_vector("embedding") & F.col("vec_id").isNotNull())
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").groupBy("vec_id", "embedding")
        return df.agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("embedding"))

    q, c = ready(queries), ready(candidates)
    # a query entry stands for COPIES rows at most
    q = q.withColumn("_b", F.explode(F.expr(f"sequence(0L, (times - 1) div {COPIES})")))
    q = q.withColumn("times", F.expr(f"least(times - _b * {COPIES}, {COPIES}L)")).withColumn("query", F.monotonically_increasing_id()).drop("_b")
    q = saved(q)  # written: the numbers stay
    n_q, n_c = (max(1, -(-df.count() // n)) for df, n in ((q, QUERIES), (candidates, CANDIDATES)))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    q = q.select("*", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("j"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), block(n_c).alias("j"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        rows = []
        if len(a) and len(b):
            ids, times = (x.column("vec_id").to_numpy() for x in (a, b)), b.column("times").to_numpy()
            rows = list(tile_top(_matrix(a.column("embedding")), next(ids), _matrix(b.column("embedding")), next(ids), k, times=times))
        own = a.take(pa.array([r[0] for r in rows], pa.int64()))
        return pa.table(
            {
                "query": own.column("query"), "query_id": own.column("vec_id"), "times": own.column("times"),
                "ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "scores": pa.array([r[2] for r in rows], pa.list_(pa.float64())),
            }
        )

    found = q.groupBy("dim", "i", "j").cogroup(c.groupBy("dim", "i", "j")).applyInArrow(tile, "query long, query_id long, times long, ids array<long>, scores array<double>")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by query: a heap for one query at a time."""
        now, about, heap = None, (0, 0), []
        out: list[tuple] = []

        def close() -> None:
            heap.sort(reverse=True)
            for copy in range(about[1] if now is not None else 0):
                out.extend((about[0], rank, -x, s, now * COPIES + copy) for rank, (s, x) in enumerate(heap, 1))
            heap.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64(), "query": pa.int64()}
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.values())], list(kinds))
            out.clear()
            return batch

        for batch in batches:
            for query, query_id, times, ids, scores in zip(*(batch.column(x).to_pylist() for x in range(5))):
                if query != now:
                    close()
                    if len(out) > 20_000:
                        yield batch_of()
                    now, about = query, (query_id, times)
                for item in zip(scores, (-x for x in ids)):
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        close()
        if out:
            yield batch_of()

    tasks = max(n_q, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(tasks, "query").sortWithinPartitions("query").mapInArrow(merged, "query_id long, rank int, vec_id long, score double, query long")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors).drop("query")


# --- near-duplicate vectors -------------------------------------------------------------------------

#: Vectors of a block, vectors of the smallest interval, leading dimensions with a grid.
ROWS, LEAF, LEADING = 1024, 128, 6
#: Parts of an interval of blocks.
WIDTH = 8


def leading_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Leading principal axes of the unit vectors of the commonest length d, from a row of sums a task: d rows x `dims`."""
    common = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return np.zeros((0, 0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            total = total + np.vstack([x.sum(axis=0), x.T @ x])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["s"])

    parts = vectors.where(F.size("embedding") == common.d).select("embedding").mapInArrow(sums, "s array<double>")
    got = parts.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    t = np.array([r.s for r in got]).reshape(-1, common.d)
    return np.linalg.eigh(t[1:])[1][:, ::-1][:, :dims]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def interval_links(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, least: float, far: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Links of two sorted sequences, as (first row, first column, matrix of links), by halving intervals.

    px and py are the rows' leading coordinates. Two intervals whose boxes there are more than `far` apart
    hold no link: an orthogonal projection brings no two points further apart.
    """
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > far * far:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            links = x[a:b] @ y[c:d].T >= least
            if same:
                links &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
            if links.any():
                yield a, c, links
        elif b - a >= d - c:
            todo += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
        else:
            todo += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]


def near_blocks(about: DataFrame, total: int, dims: int, far: float, width: int = WIDTH) -> DataFrame:
    """Pairs of blocks, a <= b, that hold vectors at most `far` apart, as their labels and boxes tell. `about`: block, numbered
    without gaps in the sequence's order, label, low, high (corners in `dims` dimensions).

    Joins the sequence with itself by intervals: an interval has the labels and the box of its blocks. From the whole sequence down,
    each pair of intervals that may hold a link is split into the pairs of their `width` parts; the others go at once. A pair is
    a row, so a label or a region that holds very many blocks is spread like any other.
    """
    levels = 0
    while width**levels < total:
        levels += 1
    pairs = about.sparkSession.range(1 if total else 0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    corner = lambda f, c: F.array(*(f(F.col(c)[d]) for d in range(dims)))
    apart = "aggregate(zip_with(zip_with(x.low, y.high, (s, t) -> s - t), zip_with(y.low, x.high, (s, t) -> s - t), (s, t) -> greatest(s, t, 0.0D)), 0.0D, (s, t) -> s + t * t)"
    for level in range(levels - 1, -1, -1):
        boxes = about.groupBy(F.floor(F.col("block") / width**level).alias("node"))
        boxes = boxes.agg(F.min("label").alias("first"), F.max("label").alias("last"), corner(F.min, "low").alias("low"), corner(F.max, "high").alias("high"))
        parts = boxes.groupBy(F.floor(F.col("node") / width).alias("of")).agg(F.collect_list(F.struct("node", "first", "last", "low", "high")).alias("parts"))
        for side, part in (("a", "x"), ("b", "y")):
            pairs = pairs.join(parts.select(F.col("of").alias(side), F.col("parts").alias(f"{part}s")), side)
        pairs = pairs.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
        pairs = pairs.where(f"x.node <= y.node AND x.first <= y.last AND y.first <= x.last AND {apart} <= {far * far}")
        pairs = saved(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    return pairs


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Links of vectors with equal label and cosine >= `least`: vec_id, n_links, component_id, kept, label.

    One row per row of `vectors` (vec_id, label, embedding); rows alike in vec_id are vectors of their own
    and link with each other like others. component_id is the smallest vec_id reachable (null ids aside).
    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different length. An empty table gives an empty result.

    Vectors are sorted by label and grid cells, of a width that no linked pair exceeds, on the leading principal
    dimensions, dealt by sampled ranges and cut into blocks. The sequence of blocks is joined with itself by intervals, see
    near_blocks(), and each pair of blocks left by halving; a tile returns a count per vector and a spanning forest, never all its links.
    """
    dims = LEADING
    far = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + 1e-9) + 1e-9
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    good = valid_vector("embedding") & F.col("label").isNotNull()
    lone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "label")
    rows = rows.where(good)
    axes = leading_axes(rows, dims)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = np.asarray(column.value_lengths())
            for d in np.unique(lengths):
                some = batch.filter(pa.array(lengths == d))
                x = _unit(_matrix(some.column("embedding")))
                p = x @ axes if len(axes) == d else np.zeros((len(x), dims))
                cells = [pa.array(c, pa.int32()) for c in np.floor(p / far).astype(np.int32).T[:3]]
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("label"), pa.array(np.full(len(x), d), pa.int32()), *cells, pa.array(list(p), pa.list_(pa.float64())), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["vec_id", "label", "dim", "c0", "c1", "c2", "p", "x"],
                )

    while axes.shape[1] < 3 and len(axes):  # short vectors: further coordinates are all 0
        axes = np.hstack([axes, np.zeros((len(axes), 1))])
    dims = axes.shape[1] if len(axes) else dims
    keys = ["label", "dim", "c0", "c1", "c2"]
    spread = rows.mapInArrow(placed, "vec_id long, label string, dim int, c0 int, c1 int, c2 int, p array<double>, x binary")
    order = [*keys, F.col("p")[0], F.xxhash64("vec_id", "x")]
    n_parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = spread.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def block() -> pa.RecordBatch:
            nonlocal number, held
            p = np.array([h[2] for h in held])
            out = pa.RecordBatch.from_pylist(
                [{"block": number, "label": f"{key[0]}\0{key[1]}", "n": len(held), "low": p.min(0).tolist(), "high": p.max(0).tolist(), "x": b"".join(h[3] for h in held), "ids": [h[0] for h in held], "p": p.astype(np.float64).tobytes()}],
                schema=pa.schema([("block", pa.int64()), ("label", pa.string()), ("n", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("x", pa.binary()), ("ids", pa.list_(pa.int64())), ("p", pa.binary())]),
            )
            number, held = number + 1, []
            return out

        for batch in batches:
            for vec_id, label, dim, p, x in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "dim", "p", "x"))):
                if held and ((label, dim) != key or len(held) >= ROWS):
                    yield block()
                key = (label, dim)
                held.append((vec_id, key, p, x))
        if held:
            yield block()

    made = saved(spread.mapInArrow(blocks, "block long, label string, n int, low array<double>, high array<double>, x binary, ids array<long>, p binary"))
    # blocks numbered without gaps in the order of the sequence: a count a partition tells where its numbers begin
    sizes = {r.p: r.n for r in made.groupBy(F.shiftright("block", 32).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins, total = [], 0
    for part in sorted(sizes):
        begins.append((part, total))
        total += sizes[part]
    begins = made.sparkSession.createDataFrame(begins, "_p long, _begin long")  # a row a partition
    made = made.join(F.broadcast(begins), F.shiftright("block", 32) == F.col("_p")).withColumn("block", F.col("block") % (1 << 32) + F.col("_begin")).drop("_p", "_begin")
    body = made.select("block", "n", "x", "p")
    pairs = near_blocks(made.select("block", "label", "low", "high"), total, dims, far)
    pairs = pairs.select(F.col("a").alias("a_block"), F.col("b").alias("b_block"))
    for s in "ab":
        pairs = pairs.join(body.select(*(F.col(c).alias(f"{s}_{c}") for c in body.columns)), f"{s}_block")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                x, y = (np.frombuffer(row[f"{s}_x"]).reshape(row[f"{s}_n"], -1) for s in "ab")
                px, py = (np.frombuffer(row[f"{s}_p"]).reshape(row[f"{s}_n"], -1) for s in "ab")
                same = row["a_block"] == row["b_block"]
                shift = 0 if same else len(x)  # rows of both blocks are numbered on
                counts, edges = np.zeros(len(x) + (0 if same else len(y)), np.int64), []
                for i, j, links in interval_links(x, y, px, py, same, least, far):
                    counts[i : i + len(links)] += links.sum(1)
                    counts[shift + j : shift + j + links.shape[1]] += links.sum(0)
                    at = np.argwhere(links) + [i, shift + j]
                    edges.append(at[forest(at, len(counts))])
                at = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
                at = at[forest(at, len(counts))]
                name = np.concatenate([row["a_block"] * ROWS + np.arange(len(x)), row["b_block"] * ROWS + np.arange(len(counts) - shift if not same else 0)])
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([name[some], name[at[:, 0]]])), pa.array(np.concatenate([counts[some], np.zeros(len(at), np.int64)])), pa.array([None] * len(some) + name[at[:, 1]].tolist(), pa.int64())],
                    ["node", "n", "other"],
                )

    links = saved(pairs.repartition(n_parts * 2, "a_block", "b_block").mapInArrow(tile, "node long, n long, other long"))
    sums = links.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n_links"))
    joined = components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = made.select("block", F.split("label", "\0")[0].alias("label"), F.posexplode("ids").alias("i", "vec_id"))
    nodes = nodes.select((F.col("block") * ROWS + F.col("i")).alias("node"), "vec_id", "label")
    nodes = nodes.join(sums, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = nodes.where("n_links > 0")
    least_id = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = linked.join(least_id, "root").select("vec_id", "n_links", "component_id", "label")
    out = out.unionByName(nodes.where("n_links IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "label")).unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")
