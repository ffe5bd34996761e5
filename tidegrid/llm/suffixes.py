"""Exact removal of byte strings that occur more than once, by a distributed sparse suffix array.

A string of `length` bytes (200) is judged at one of its suffixes only: the one whose leading `GRAM` bytes have
the smallest hash in the string, so equal strings are judged at the same place. These anchors are about one
byte in ninety. Anchors whose leading bytes occur once are dropped; the others are dealt to buckets by the
bytes from the anchor on, in ranges between sampled splitters. A bucket sorts its suffixes, and the text before
them read backwards, by multikey quicksort; common prefixes of neighbours in the two orders tell which
strings around an anchor are equal. Suffixes that begin like a splitter might have partners in the next bucket: their
strings are compared across buckets by digest.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, table
from .hashing import mix

LENGTH, GRAM = 200, 32
#: Neighbouring strings of a suffix that travel together across buckets.
TOGETHER = 8
#: Bytes scanned at once; suffixes of a bucket; suffixes sampled for splitters.
BLOCK, PER_BUCKET, SAMPLED = 1 << 19, 10_000, 20_000
#: Places in a block, which anchors() numbers in 20 bits; texts with an anchor's leading bytes from which on its strings travel one by one.
PLACES, HOT = 1 << 20, 10_000
NONE = -(1 << 63)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on."""
    a = b.astype(np.uint64)
    for k in (1, 2, 4):  # eight bytes from each place on as one number
        a = a[:-k] | (a[k:] << np.uint64(8 * k))
    n = len(b) - GRAM + 1
    with np.errstate(over="ignore"):
        h = a[:n] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(8, GRAM, 8):
            h = (h ^ (h >> np.uint64(29)) ^ a[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
    return mix(h)


def anchors(b: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts laid end to end, `ends` their ends: place, hash, and first and last string judged there.

    A string is the `length` bytes from its place on, within one text. Of equal hashes the last one counts.
    """
    w = length - GRAM + 1
    if len(b) < length:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    h = gram_hashes(b)
    low = np.uint64((1 << 20) - 1)
    v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    rows = -(-len(v) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max)
    grid[: len(v)] = v
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(b) - length + 1
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    at = (low - (least & low)).astype(np.int64)
    start = np.arange(n)
    inside = ends[np.searchsorted(ends, start, side="right")] - start >= length
    start, at = start[inside], at[inside]
    if not len(at):
        return at, h[:0], at, at
    new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
    return at[new], h[at[new]], start[new], start[np.append(new[1:], len(start)) - 1]


def scanned(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: for its anchors the text, then the block's bytes, the anchors' places in it, hashes, first
    and last strings, and what to add to a place for the place in its text. A long text spans blocks that overlap."""
    rows: list[tuple[int, int, bytes]] = []
    held = 0

    def block():
        data = b"".join(p for _, _, p in rows)
        ends = np.cumsum([len(p) for _, _, p in rows])
        at, h, first, last = anchors(np.frombuffer(data, np.uint8), ends, length)
        row = np.searchsorted(ends, first, side="right")
        shift = np.array([o for _, o, _ in rows]) - np.append(0, ends[:-1])
        return np.array([i for i, _, _ in rows])[row], data, at, h, first, last, shift[row]

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), BLOCK):
            part = t[o : o + BLOCK + length - 1]
            if held + len(part) > PLACES:
                yield block()
                rows, held = [], 0
            rows.append((i, o, part))
            held += len(part)
            if held >= BLOCK:
                yield block()
                rows, held = [], 0
    if rows:
        yield block()


def text_anchors(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and hash of anchors, all of a text together: those of a text of several blocks are put together first."""
    long = [i for i, t in enumerate(texts) if len(t) - length + 1 > BLOCK]
    for row, _, at, h, _, _, shift in scanned([b"" if i in long else t for i, t in enumerate(texts)] if long else texts, length):
        yield row, at + shift, h
    for i in long:
        at, h = map(np.concatenate, zip(*((at + shift, h) for _, _, at, h, _, _, shift in scanned([texts[i]], length))))
        yield np.full(len(at), i), at, h


def _blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    first, texts, held = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        texts.append((t.as_py() or "").encode())
        held += len(texts[-1])
        if held > 8 << 20:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of whole numbers by multikey quicksort: split in three by one column, equal rows by the next."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        own = order[a:b]
        if b - a <= 48:
            order[a:b] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        key = words[own, depth]
        pivot = np.sort(key[:: max(1, len(key) // 9)])[min(4, (len(key) - 1) // 2)]
        less, more = key < pivot, key > pivot
        n_less, n_more = int(less.sum()), int(more.sum())
        order[a:b] = np.concatenate([own[less], own[~(less | more)], own[more]])
        todo += [(a, a + n_less, depth), (a + n_less, b - n_more, depth + 1), (b - n_more, b, depth)]
    return order


def _sorted(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the common prefix of each with the one before it in that order."""
    size = -(-size // 8) * 8
    raw = np.frombuffer(b"".join(s.ljust(size, b"\0") for s in strings), np.uint8).reshape(len(strings), size)
    order = multikey_order(np.ascontiguousarray(raw).view(">u8").astype(np.uint64))
    raw = raw[order]
    differs = raw[1:] != raw[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
    return order, np.append(0, common)


def equal_strings(left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, times: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings around anchors occur more than once: rows of length - GRAM + 1, true at the distance of the
    string's start before the anchor.

    left and right: the bytes before and from each anchor on; lo to hi: the distances judged; times: how often
    the row occurs. Strings at distance d are equal if they share d bytes before and length - d after the anchor.
    """
    n, most = len(left), length - GRAM
    found = np.zeros((n, most + 1), bool)
    order_r, common_r = _sorted(right, length)
    order_l, common_l = _sorted([s[::-1] for s in left], most)
    of_r, of_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        rows = np.flatnonzero((lo <= d) & (hi >= d))
        if not len(rows):
            continue
        of_r[order_r] = np.cumsum(common_r < length - d)
        of_l[order_l] = np.cumsum(common_l < d)
        key = of_r[rows] * (n + 1) + of_l[rows]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[by], prepend=-1))
        sums = np.add.reduceat(times[rows[by]], new)
        found[rows[by], d] = np.repeat(sums > 1, np.diff(np.append(new, len(by))))
    return found


ROW = "bucket int, bytes binary, left int, lo int, hi int, times long, did array<long>, th array<long>, at array<long>"
SPAN = "did long, th long, lo long, hi long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], [c.split()[0] for c in SPAN.split(", ")])


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """did, th, lo, hi: spans of bytes of `docs` (did long, th long, text) covered by strings that start elsewhere too.

    What surrounds an anchor, and so all strings judged there, is sent to a bucket with its places. Equal surroundings that
    meet, in a task that reads texts or in a bucket, are settled at once: their strings start in two places at least. So no
    task holds more places than distinct surroundings, one each. An anchor whose leading bytes are in more than `hot` texts
    sends its strings one by one: those that very many texts share meet as one, whatever is around them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounded_batches(docs.sparkSession)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            for first, texts in _blocks(batch):
                for row, at, h in text_anchors(texts, length):
                    by = np.lexsort((at, h, row))  # an anchor's string counts once a text, with a mark if it is at several places
                    row, at, h = row[by], at[by], h[by]
                    new = np.diff(row, prepend=-1).astype(bool) | (np.diff(h.view(np.int64), prepend=0) != 0)
                    if not len(by):
                        continue
                    new[0] = True
                    heads = np.flatnonzero(new)
                    places = np.add.reduceat(new | (np.diff(at, prepend=-1) != 0), heads)  # one seen from two blocks is one
                    row, at, h = row[heads], at[heads], h[heads]
                    some = mix(h ^ did[first + row].view(np.uint64)) % np.uint64(32) == 0
                    lead = [texts[r][a : a + length] if s else None for r, a, s in zip(row.tolist(), at.tolist(), some.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(did[first + row]), pa.array(th[first + row]), pa.array(h.view(np.int64)), pa.array(places > 1), pa.array(lead, pa.binary())], ["did", "th", "h", "many", "lead"]
                    )

    each = docs.where(F.octet_length("text") >= length).mapInArrow(grams, "did long, th long, h long, many boolean, lead binary")
    seen = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many")).where("n > 1 OR many").select("h", (F.col("n") > hot).alias("hot"))
    shared = each.join(seen, "h")
    wanted = saved(shared.groupBy("did", "th").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"), F.max("lead").alias("lead"), F.count(F.lit(1)).alias("n")))
    wanted = wanted.withColumn("alike", (F.col("n") / F.size("hs")).cast("long"))  # rows with this doc_id and text
    total, leads = wanted.agg(F.sum(F.size("hs").cast("long")), F.count("lead")).first()
    # ranges between splitters, whose number the driver bounds, and each range in parts by its suffixes' leading bytes
    ranges = max(parts, -(-(total or 0) // PER_BUCKET))
    ranges, split = min(ranges, SAMPLED // 4), -(-ranges // (SAMPLED // 4))
    buckets = ranges * split
    sample = wanted.where(F.col("lead").isNotNull() & (F.pmod(F.xxhash64("lead", "did"), F.lit(1 << 20)) < (1 << 20) * SAMPLED // max(1, leads)))
    sample = sorted(bytes(r.lead) for r in sample.select("lead").collect())
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    edges = {s[:GRAM] for s in splitters}

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            hs, hot_, alike = batch.column("hs"), batch.column("hot"), batch.column("alike").to_numpy() > 1
            again = np.append(False, (did[1:] == did[:-1]) & (th[1:] == th[:-1]))

            def noted(put: list, r: int, at: int) -> None:
                put[3] += 2 if alike[r] else 1
                if not alike[r]:
                    put[0].append(did[r]), put[1].append(th[r]), put[2].append(at)

            for first, texts in _blocks(batch):
                rows: dict[tuple, list] = {}
                for i, t in enumerate(texts):
                    if alike[first + i]:  # all of it occurs twice; it is read once, for the others' sake
                        if not again[first + i]:
                            rows[0, None, first + i] = [[did[first + i]], [th[first + i]], [0], 0, len(t)]
                        else:
                            texts[i] = b""
                for row, data, at, h, lo, hi, shift in scanned(texts, length):
                    row, h = first + row, h.view(np.int64)
                    for r in np.unique(row):
                        own = np.flatnonzero(row == r) if len(texts) == 1 else np.arange(*np.searchsorted(row, [r, r + 1]))
                        own = own[np.isin(h[own], hs[int(r)].values.to_numpy())]
                        crowded = np.isin(h[own], hot_[int(r)].values.to_numpy()).tolist()
                        for i, many in zip(own.tolist(), crowded):
                            p, a, z, o = int(at[i]), int(lo[i]), int(hi[i]), int(shift[i])
                            if many or data[p : p + GRAM] in edges:
                                size = 1 if many else TOGETHER
                                for j in range((p - z) // size, (p - a) // size + 1):
                                    near, away = max(p - z, j * size), min(p - a, (j + 1) * size - 1)
                                    core = data[p - j * size : p + length - (j + 1) * size + 1]
                                    name = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little") % buckets
                                    put = rows.setdefault((name, data[p - away : p - near + length], away, near, away), [[], [], [], 0])
                                    noted(put, r, p + o)
                            else:
                                at_bucket = bisect.bisect_right(splitters, data[p : z + length]) * split + int(h[i]) % split
                                noted(rows.setdefault((at_bucket, data[a : z + length], p - a, p - z, p - a), [[], [], [], 0]), r, p + o)
                    if len(rows) > 20_000:
                        yield _suffix_batch(rows)
                        rows = {}
                if rows:
                    yield _suffix_batch(rows)

    def _suffix_batch(rows: dict) -> pa.RecordBatch:
        """Surroundings and their places. What has several is settled here: its places go to any bucket, without the bytes."""
        out = []
        for k, (did, th, at, times, *whole) in rows.items():
            if whole:
                out.append((int(did[0]) % buckets, None, 0, length - whole[0], 0, 0, did, th, at))
                continue
            out.append((*k, times, *((did, th, at) if times == 1 else ([], [], []))))
            if times > 1 and did:
                out.append((int(did[0]) % buckets, None, *k[2:], 0, did, th, at))
        kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], [c.split()[0] for c in ROW.split(", ")])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, tuple | None] = {}  # of surroundings met once so far
        settled: list[tuple] = []
        for batch in batches:
            for data, left, lo, hi, times, *at in zip(*(batch.column(c).to_pylist() for c in ("bytes", "left", "lo", "hi", "times", "did", "th", "at"))):
                own = list(zip(*at))
                if data is not None:
                    before = place.get(key := (data, left, lo, hi))
                    alone = key not in place and times == 1
                    place[key] = own[0] if alone else None
                    own = [] if alone else own + [before] * (before is not None)
                settled += [(d, t, p - hi, p - lo + length) for d, t, p in own]
                if len(settled) > 20_000:
                    yield _spans(settled)
                    settled = []
        if settled:
            yield _spans(settled)
        if not place:
            return
        keys = list(place)
        data, at, lo, hi = zip(*keys)
        times = np.array([1 if place[k] else 2 for k in keys])
        found = equal_strings([d[:a] for d, a in zip(data, at)], [d[a:] for d, a in zip(data, at)], np.array(lo), np.array(hi), times, length)
        found[times > 1] = False
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rows, begin = np.nonzero(edge == 1)  # runs of distances, begin to end - 1
        end = np.nonzero(edge == -1)[1]
        if len(rows):
            own = [place[keys[r]] for r in rows.tolist()]
            yield _spans([(d, t, p - e + 1, p - b + length) for (d, t, p), b, e in zip(own, begin.tolist(), end.tolist())])

    # the texts are moved by the same keys and columns as in without_repeated_bytes(), so Spark moves them once
    rows = docs.join(wanted.select("did", "th", "hs", "hot", "alike"), ["did", "th"]).mapInArrow(suffixes, ROW)
    return rows.repartition(buckets, "bucket").mapInArrow(compared, SPAN)


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the remaining bytes), spans (array of lo, hi: maximal removed runs), n_bytes.

    Each byte of the UTF-8 text goes that a string of `length` bytes covers which also starts anywhere else, in
    the same document or another, judged on the input. Null text is empty. Every row is a document of its
    own: rows alike in doc_id and text remove each other. Matches end with their document. An empty table gives an
    empty result; other columns aren't read.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("did"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(keyed, length, hot)
    spans = spans.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # rows alike have the same ones

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for did, text, spans_ in zip(*(batch.column(c) for c in ("did", "text", "spans"))):
                data, runs = text.as_py().encode(), []
                for s in sorted((s["lo"], s["hi"]) for s in spans_.as_py() or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((None if (d := did.as_py()) == NONE else d, kept, [{"lo": a, "hi": b} for a, b in runs], len(data)))
                held += len(data)
                if held > 8 << 20:
                    yield _cut_batch(out)
                    out, held = [], 0
            if out:
                yield _cut_batch(out)

    def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "kept", "spans", "n_bytes"])

    schema = "doc_id long, kept binary, spans array<struct<lo: long, hi: long>>, n_bytes long"
    return keyed.join(spans, ["did", "th"], "left").mapInArrow(cut, schema)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("n_bytes - length(kept)").cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
