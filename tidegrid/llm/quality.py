"""Choosing documents like a target by importance resampling on hashed n-grams.

Words and pairs of words are hashed to buckets. Two generative models, of the target texts and of all
texts, give each bucket a probability; the importance of a document is the ratio of the two for its
n-grams. Gumbel noise makes the largest sums of log-importance and noise a sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, saved, small, table, unit_hash
from .hashing import mix, word_hashes

BUCKETS = 1 << 14


def ngram_buckets(words: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all pairs of words of one text, and the text of each."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    inside = text[:-1] == text[1:]
    grams = np.concatenate([mix(words), pairs[inside]])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[:-1][inside]])


def _blocks(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, some bytes at a time, with the place of the first."""
    first, texts, held = 0, [], 0
    for i, t in enumerate(column):
        texts.append((t.as_py() or "").encode())
        held += len(texts[-1])
        if held > size:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-grams of all `texts` (text, target boolean) and of the target ones. A task sends
    a count a bucket, whatever it has read."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = np.array(batch.column(1).to_pylist(), bool)
            for first, texts_ in _blocks(batch.column(0)):
                b, t = ngram_buckets(*word_hashes(texts_), buckets)
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[target[first + t]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "raw", "target"])

    parts = texts.select("text", "target").mapInArrow(counted, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list, buckets: int = BUCKETS, smooth: float = 0.5) -> np.ndarray:
    raw, target = np.full(buckets, smooth), np.full(buckets, smooth)
    for r in counts:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(scores: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest `score` of a table, and how many lie above it; exact, by counts of 4096 ranges a pass."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    if low is None or k < 1:
        return math.inf, 0
    above = 0
    while True:
        inside = scores.where((F.col("score") >= low) & (F.col("score") <= high))
        step = (high - low) / 4096
        if step <= 0 or low + step == low:
            return low, above
        at = F.least(F.floor((F.col("score") - low) / step), F.lit(4095))
        ranges = inside.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).collect()
        for r in sorted(ranges, key=lambda r: -r["at"]):
            if above + r.n >= k:
                break
            above += r.n
        if r.a == r.b:
            return r.a, above
        low, high = r.a, r.b


def resampled(docs: DataFrame, target: DataFrame, share: float = 0.9, buckets: int = BUCKETS, seed: int = 11, power: float = 0.0) -> DataFrame:
    """doc_id, n_grams, log_ratio, log_weight, score, selected: a row per row of `docs` (doc_id, text).

    `target` (doc_id): the documents to resemble. log_ratio is the sum of the log-ratios of the two models over a text's
    n-grams; log_weight is that sum over the `power` of their number: with 0 it is the importance weight itself, with 0.5 long
    texts don't rule by length alone. score adds Gumbel noise from a hash of doc_id and text. The `share` of the rows with the largest scores is
    selected, rounded up, not one more: of rows tied at the edge, such as repeated ones, as many as are wanted. Texts that are null or have no words are never selected:
    their log_weight is null and they don't count. Repeated rows get equal scores. With no target, or an
    empty table, weights are those of equal models, 0.
    """
    bounded_batches(docs.sparkSession)
    wanted = target.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_t")).distinct()
    wanted = small(wanted, wanted.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = texts.join(wanted, texts.doc_id == F.col("_t"), "left").select("text", F.col("_t").isNotNull().alias("target"))
    counts = bucket_counts(marked.where("text IS NOT NULL"), buckets).collect()
    ratio = log_ratios(counts, buckets) if any(r.target for r in counts) else np.zeros(buckets)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, some in _blocks(batch.column("text")):
                b, t = ngram_buckets(*word_hashes(some), buckets)
                n[first : first + len(some)] = np.bincount(t, minlength=len(some))
                total[first : first + len(some)] = np.bincount(t, weights=ratio[b], minlength=len(some))
            ratios, weights = (pa.array(x, mask=n == 0) for x in (total, total / np.maximum(n, 1) ** power))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("u"), pa.array(n), ratios, weights], ["doc_id", "u", "n_grams", "log_ratio", "log_weight"])

    rows = texts.select("doc_id", unit_hash("doc_id", "text", seed=seed).alias("u"), "text").mapInArrow(weighed, "doc_id long, u double, n_grams long, log_ratio double, log_weight double")
    rows = saved(rows.select("doc_id", "n_grams", "log_ratio", "log_weight", (F.col("log_weight") + gumbel(F.col("u"))).alias("score")))
    usable = rows.where("score IS NOT NULL").select("score")
    k = math.ceil(usable.count() * share)
    least, above = kth_largest(usable, k)
    tied = usable.where(F.col("score") == least).count() if k else 0
    if above + tied <= k:
        return rows.withColumn("selected", F.coalesce(F.col("score") >= least, F.lit(False)))
    edge = numbered(rows.where(F.col("score") == least), ["score"]).withColumn("selected", F.col("_nth") <= k - above).drop("_nth")
    rest = rows.where(~F.col("score").eqNullSafe(F.lit(least)))
    return rest.withColumn("selected", F.coalesce(F.col("score") > least, F.lit(False))).unionByName(edge)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to resemble those labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), good.select("doc_id"))
