"""Near-duplicate documents by weighted MinHash signatures of their word shingles (BagMinHash).

A document is the bag of its five-word shingles. A shingle of weight w owns, on each of the unit steps of the
weight axis up to w, a Poisson process in time; the steps are held in dyadic intervals, 1, 2 to 3, 4 to 7 and
so on, each a process of its own from a seed of shingle and interval, whose points carry a place on the weight
axis and are left out beyond w. Points fall on a random register, which keeps the earliest. Two documents agree
in a register with the probability of their weighted Jaccard similarity. Intervals stop as soon as their
next point comes later than all registers.

Registers in bands give candidates; candidates are verified on the bags themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, bounded_batches, forest, numbered, repeated, saved, table
from .components import components
from .hashing import mix, shingles, word_hashes

REGISTERS, BANDS, ROWS = 128, 25, 5
SHINGLES_AT_ONCE = 400_000
#: Documents and items of a block.
PER_BLOCK, ITEMS_PER_BLOCK = 256, 400_000
LAST = (1 << 63) - 1


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """Registers (rows of m times) of bags, each distinct 64-bit items and their whole weights."""
    doc = np.repeat(np.arange(len(bags)), [len(i) for i, _ in bags])
    item, weight = (np.concatenate([b[k] for b in bags]) for k in (0, 1))
    level = 0
    parts = []
    while len(doc):
        width = max(1, 1 << level >> 1)  # 1, 1, 2, 4: steps [0, 1), [1, 2), [2, 4), [4, 8)
        low = 0 if level == 0 else 1 << (level - 1)
        own = weight > low
        doc, item, weight = doc[own], item[own], weight[own]
        parts.append((doc, mix(item ^ np.uint64(0xA5A5 + level * 0x1F123BB5)), weight - low, np.full(len(doc), width)))
        level += 1
    doc, seed, room, width = (np.concatenate([p[k] for p in parts]) for k in range(4))
    times = np.full(len(bags) * m, np.inf)
    latest = np.full(len(bags), np.inf)
    t, step = np.zeros(len(doc)), 0
    unit = 1.0 / (1 << 53)
    while len(doc):
        step += 1
        with np.errstate(over="ignore"):
            h = mix(seed + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
        t = t - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * unit) / width
        on = t < latest[doc]
        doc, seed, room, width, t, h = (x[on] for x in (doc, seed, room, width, t, h))
        g = mix(h ^ np.uint64(0xD1B54A32D192ED03))
        place = ((g >> np.uint64(20)) % width.astype(np.uint64)).astype(np.int64)
        taken = place < room
        np.minimum.at(times, doc[taken] * m + (g & np.uint64(0xFFFFF)).astype(np.int64)[taken] % m, t[taken])
        latest = times.reshape(-1, m).max(axis=1)
    return times.reshape(-1, m)


def _bag(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(words, n), return_counts=True)


def _items(words: np.ndarray, n: int) -> np.ndarray:
    """A bag as a sorted set: the k-th copy of a shingle is an item of its own."""
    item, count = _bag(words, n)
    copy = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return np.sort(np.where(copy > 0, mix(np.repeat(item, count) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(item, count)))


def overlaps(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Numbers of common items of each set of `a` with each of `b` (sets end to end, and their sizes)."""
    out = np.zeros((len(a_sizes), len(b_sizes)), np.float32)
    both = np.intersect1d(a, b)
    sides = []
    for items, sizes in ((a, a_sizes), (b, b_sizes)):
        at = np.minimum(np.searchsorted(both, items), max(0, len(both) - 1))
        hit = both[at] == items if len(both) else np.zeros(len(items), bool)
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]))
    for low in range(0, len(both), columns):
        x, y = (np.zeros((len(sizes), columns), np.float32) for sizes in (a_sizes, b_sizes))
        for grid, (row, at) in zip((x, y), sides):
            own = (at >= low) & (at < low + columns)
            grid[row[own], at[own] - low] = 1
        out += x @ y.T
    return out


def similar(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, least: float) -> np.ndarray:
    """Pairs (rows of two numbers) of sets with a similarity of at least `least`."""
    both = overlaps(a, a_sizes, b, b_sizes).astype(np.float64)
    total = a_sizes[:, None] + b_sizes[None, :] - both
    return np.argwhere((both >= least * total - 1e-9) & (total > 0))


def _banded(texts: DataFrame, words: int) -> DataFrame:
    """th, doc_id, text -> doc_id, th, bands: a hash of each band's registers; none for a text without words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = np.frombuffer(b"".join(batch.column("th").to_pylist()), "V16")
            _, first, again = np.unique(th, return_index=True, return_inverse=True)
            column = batch.column("text")
            bands: list[np.ndarray | None] = [None] * len(first)
            bags, at, held, raw, ids = [], [], 0, [], []

            def sign() -> None:
                nonlocal bags, at, held
                if bags:
                    bits = signatures(bags)[:, : BANDS * ROWS].view(np.uint64).reshape(len(bags), BANDS, ROWS)
                    h = np.zeros((len(bags), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        h = mix(h ^ bits[:, :, r])
                    for i, row in zip(at, h.view(np.int64)):
                        bands[i] = row
                bags, at, held = [], [], 0

            def bag() -> None:
                nonlocal raw, ids, held
                hashes, ends = word_hashes(raw)
                for i, a, b in zip(ids, ends, ends[1:]):
                    if b > a:
                        bags.append(_bag(hashes[a:b], words))
                        at.append(i)
                        held += b - a
                        if held >= SHINGLES_AT_ONCE:
                            sign()
                raw, ids = [], []

            size = 0
            for i, row in enumerate(first.tolist()):
                raw.append(column[row].as_py().encode())
                ids.append(i)
                size += len(raw[-1])
                if size > 4 << 20:
                    bag()
                    size = 0
            bag()
            sign()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([bands[i] for i in again], pa.list_(pa.int64()))], ["doc_id", "th", "bands"])

    return texts.select("doc_id", "th", "text").mapInArrow(signed, "doc_id long, th binary, bands array<long>")


BODY = "cluster long, block long, nodes array<long>, sizes array<long>, items binary"
LINK = "a long, b long"


def _blocks(texts: DataFrame, words: int, least: float, per_block: int) -> DataFrame:
    """`texts` (cluster, node, text), sorted by cluster within ranges -> links (a, b), and the body of each block whose
    cluster may go on in another block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, cluster, whole = TaskContext.get().partitionId() << 32, None, False
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def block(ends_here: bool) -> pa.RecordBatch:
            nonlocal number, nodes, sets, held
            items, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
            pairs = similar(items, sizes, items, sizes, least) if len(sets) > 1 else np.zeros((0, 2), np.int64)
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
            pairs = pairs[forest(pairs, len(sets))]
            names = np.array(nodes)
            out: dict[str, list] = {"cluster": [cluster] * len(pairs), "block": [None] * len(pairs), "nodes": [None] * len(pairs), "sizes": [None] * len(pairs), "items": [None] * len(pairs)}
            out |= {"a": names[pairs[:, 0]].tolist(), "b": names[pairs[:, 1]].tolist()}
            if not (whole and ends_here):
                for k, v in (("cluster", cluster), ("block", number), ("nodes", nodes), ("sizes", sizes.tolist()), ("items", items.tobytes()), ("a", None), ("b", None)):
                    out[k].append(v)
            number, nodes, sets, held = number + 1, [], [], 0
            longs = pa.list_(pa.int64())
            kinds = {"cluster": pa.int64(), "block": pa.int64(), "nodes": longs, "sizes": longs, "items": pa.binary(), "a": pa.int64(), "b": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                hashes, ends = word_hashes([t.as_py().encode() for t in part.column("text")])
                for c, node, i, j in zip(part.column("cluster").to_pylist(), part.column("node").to_pylist(), ends, ends[1:]):
                    if sets and (c != cluster or len(sets) >= per_block or held >= ITEMS_PER_BLOCK):
                        yield block(c != cluster)
                        whole = c != cluster
                    cluster = c
                    nodes.append(node)
                    sets.append(_items(hashes[i:j], words))
                    held += len(sets[-1])
        if sets:
            yield block(False)

    return texts.mapInArrow(cut, f"{BODY}, {LINK}")


def _tiles(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Links between the blocks of `pairs` (x, y: block numbers): a spanning forest of each tile."""
    for side in "xy":
        pairs = pairs.join(bodies.select(F.col("block").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("nodes", "sizes", "items"))), side)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (n, s, i), (m, t, j) = (
                    (np.array(batch.column(f"{k}_nodes")[r].as_py()), np.array(batch.column(f"{k}_sizes")[r].as_py()), np.frombuffer(batch.column(f"{k}_items")[r].as_py(), np.uint64)) for k in "xy"
                )
                found = similar(i, s, j, t, least) + [0, len(n)]
                found = found[forest(found, len(n) + len(m))]
                names = np.concatenate([n, m])
                yield pa.RecordBatch.from_arrays([pa.array(names[found[:, 0]], pa.int64()), pa.array(names[found[:, 1]], pa.int64())], ["a", "b"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(pairs.repartition(tasks, "x", "y").mapInArrow(compared, LINK))


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, per_block: int = PER_BLOCK) -> DataFrame:
    """Groups of `docs` (doc_id, text) reached by links of similarity >= `least`: doc_id, th, class_id, kept.

    A row per row of `docs`; th is the MD5 of the text, class_id the smallest doc_id of the group, and
    one row of each group is kept: with that doc_id, of the smallest th; of rows alike in both, one.
    Texts with fewer than `words` words are one shingle. Null texts and texts without words are compared with nothing; each is a group
    of its own and kept. Null doc_ids are ordered last. An empty table gives an empty result.

    Texts of one MD5 are one node from the start. Members of a band's bucket meet in a cluster; clusters are sorted and
    cut into blocks, in which all pairs of a cluster are compared at once. Clusters of several blocks go on by tiles:
    first their first block with the others, then those pairs of blocks that aren't in one group yet. So every pair of a bucket
    is compared or already in one group; none is written but the links of spanning forests, and no bucket is capped.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("th"))
    rows, heads = _grouped(keyed, words, least, per_block)
    lone = keyed.where(~has_words("text")).select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    chief = F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    rows = rows.withColumn("kept", chief).drop("head")
    twins = heads.where("n > 1")
    if twins.limit(1).count():  # rows alike in doc_id and text: one of them stays
        rows = rows.where("NOT kept").unionByName(heads.where("n = 1").select("doc_id", "th", "class_id", F.lit(True).alias("kept")))
        rows = rows.unionByName(repeated(twins, "n").select("doc_id", "th", "class_id", (F.col("_i") == 1).alias("kept")))
    return rows.unionByName(lone)


def has_words(text: str) -> Column:
    return F.coalesce(F.col(text).rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))


def _grouped(keyed: DataFrame, words: int, least: float, per_block: int) -> tuple[DataFrame, DataFrame]:
    """`keyed` (doc_id, text, th) -> its rows with words, as doc_id, th, class_id, head (whether th is the group's smallest with class_id),
    and of those to keep doc_id, th, class_id and n, the rows alike."""
    spark = keyed.sparkSession
    bounded_batches(spark)
    rows = saved(_banded(keyed.where(has_words("text")), words))
    nodes = rows.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))  # written: the numbers stay
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("b")).where("size > 1").drop("size")
    shared = saved(members.join(buckets, ["band", "key"]).select("band", "key", "node", "b"))
    # a link a node, to its smallest centre, and those that join the smallest centres of a bucket's members
    near = shared.groupBy("node").agg(F.min("b").alias("least"))
    meet = shared.join(near, "node").select("band", "key", "least")
    both = meet.join(meet.groupBy("band", "key").agg(F.min("least").alias("b")), ["band", "key"])
    both = both.where("least <> b").select(F.col("least").alias("a"), "b").distinct()
    clusters = components(near.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(both))
    wanted = clusters.join(nodes.select("node", "th", "doc_id"), "node")
    wanted = wanted.select("node", F.col("th").alias("_th"), F.col("doc_id").alias("_d"), F.col("root").alias("cluster"))
    same = (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    texts = keyed.join(wanted, same).select("cluster", "node", "text").dropDuplicates(["node"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = saved(_blocks(texts.repartitionByRange(tasks, "cluster", "node").sortWithinPartitions("cluster", "node"), words, least, per_block))
    links = found.where("a IS NOT NULL").select("a", "b")
    bodies = found.where("block IS NOT NULL").drop("a", "b")
    about = bodies.select("cluster", "block")
    first = about.groupBy("cluster").agg(F.min("block").alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", "x")
    star = about.join(first, "cluster").where("block <> x").select("x", F.col("block").alias("y"))
    links = links.unionByName(_tiles(star, bodies, least))
    groups = components(links)
    at = bodies.select("cluster", "block", F.explode("nodes").alias("node")).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = at.groupBy("cluster", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    at = saved(at.join(first, "cluster").where("block <> x").drop("x"))
    x, y = (at.select("cluster", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi"))) for s in "xy")
    one = (F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y"))
    rest = x.join(y, "cluster").where((F.col("block_x") < F.col("block_y")) & ~one).select(F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    more = _tiles(rest, bodies, least)
    if more.limit(1).count():  # else the groups stand as they are
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    # what a group is called is found over its distinct texts; the rows are joined last
    named = nodes.select("th", "doc_id", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chief = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("doc_id").isNull().alias("none"), "th"))
    heads = named.groupBy("root").agg(chief.alias("c"))
    named = saved(named.join(heads, "root").select(F.col("th").alias("_th"), F.when(~F.col("c.none"), F.col("c.d")).alias("class_id"), (F.col("th") == F.col("c.th")).alias("head")))
    rows = rows.select("doc_id", "th").join(named, F.col("th") == F.col("_th")).drop("_th")
    chief = F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows, saved(rows.where(chief).groupBy("doc_id", "th", "class_id").agg(F.count(F.lit(1)).alias("n")))


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, per_block: int = PER_BLOCK) -> DataFrame:
    """The documents without near duplicates: one row of each group, as near_duplicates() keeps them."""
    docs, back = aside(docs, "doc_id", "text")
    th, did = F.unhex(F.md5("text")), F.col("doc_id").cast("long")
    _, heads = _grouped(docs.select(did.alias("doc_id"), "text", th.alias("th")), words, least, per_block)
    heads = heads.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), F.col("n").alias("_alike"))
    rows = docs.where(has_words("text")).withColumn("_h", th)
    same = (F.col("_h") == F.col("_th")) & did.eqNullSafe(F.col("_d"))
    out = docs.where(~has_words("text")).unionByName(rows.join(heads.where("_alike = 1"), same).select(*docs.columns))
    twins = heads.where("_alike > 1")
    if twins.limit(1).count():  # rows alike in doc_id and text, of which one is kept
        which = numbered(rows.join(twins, same).withColumn("_of", F.struct("_d", "_th")), ["_of"])
        out = out.unionByName(which.where("_nth = 1").select(*docs.columns))
    return out.select(*back.values())


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "kept")
