"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

CAPACITY = 1024
#: Documents that one task packs at most on average; tasks are dealt rows in turn, without a key.
PER_TASK = 8_000
#: Letters beyond Latin, on whose classes the two encoders' libraries might differ.
UNUSUAL = re.compile("[^\x00-ɏ]")
_workers: dict = {}


def encoder(vocabulary: str):
    """text -> ids as little-endian 32-bit bytes: those of `tokenizers` with `vocabulary` and add_special_tokens=False, so
    text that spells an added token, such as `<|endoftext|>`, gets that token's id.

    Such texts and those with letters beyond Latin go to `tokenizers`, which is loaded when the first one comes; the others go
    to `tiktoken` if the same vocabulary lies beside as ranks, which takes a fifth of the time.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    kept: list[Tokenizer] = []

    def slow(text: str) -> list[int]:
        if not kept:
            kept.append(Tokenizer.from_file(vocabulary))
        return kept[0].encode(text, add_special_tokens=False).ids

    fast = slow
    ranks = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken

        added = [t.content for t in Tokenizer.from_file(vocabulary).get_added_tokens_decoder().values()]
        pairs = (line.split() for line in open(ranks, "rb"))
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        fast = lambda text: slow(text) if UNUSUAL.search(text) or any(t in text for t in added) else bpe.encode_ordinary(text)
    return lambda text: np.array(fast(text), "<u4").tobytes()


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 2) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids (binary, little-endian 32 bits).

    A document is its ids and then `end`; null text counts as empty. Only a document longer than `capacity`
    is cut, into full pieces but for the first. Repeated rows and null doc_ids are documents like others.
    """
    bounded_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _workers.get(vocabulary) or _workers.setdefault(vocabulary, encoder(vocabulary))
        mark = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + mark
                n = len(ids) // 4
                at, length = 0, n % capacity or min(n, capacity)
                while at < n:
                    rows.append((doc, at, length, ids[4 * at : 4 * (at + length)]))
                    at, length = at + length, capacity
                held += len(ids)
                if held > 8 << 20:
                    yield _piece_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _piece_batch(rows)

    def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
        doc, at, length, ids = zip(*rows)
        first = np.array(at)
        number = -(-first // capacity)  # the first piece may be shorter, the others are full
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
            ["doc_id", "piece", "start", "length", "ids"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids binary")


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """A bin and an offset for each item; all of 1 to `capacity`.

    Each bin is filled greedily with the longest items that fit; then its shortest item makes way for two
    unpacked ones, if these fill the gap and its place more tightly.
    """
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(capacity + 2))
    left = np.diff(ends).astype(np.int64)  # unpacked items of each length; taken from the end of their run
    sizes = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest unpacked length up to each
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def change(length: int, by: int) -> tuple[int, int]:
        """Take an item of this length, or put the last one back."""
        nonlocal below
        left[length] += by
        if left[length] == max(0, by):
            below = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        return length, int(ends[length] + left[length])

    number, rest = 0, len(lengths)
    while rest:
        own, gap = [], capacity
        while gap and (x := int(below[gap])):
            own.append(change(x, -1))
            gap -= x
        if gap:
            least = own[-1][0]
            room = gap + least
            a = sizes[1 : room // 2 + 1]
            b = below[room - a]
            total = np.where((left[a] > 0) & (b >= a) & ((b > a) | (left[a] > 1)), a + b, 0)
            if len(total) and total[i := int(total.argmax())] > least:
                change(least, 1)
                own[-1:] = [change(int(b[i]), -1), change(int(a[i]), -1)]
        at = 0
        for x, i in own:
            bins[order[i]], offsets[order[i]] = number, at
            at += x
        number, rest = number + 1, rest - len(own)
    return bins, offsets


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset. n_docs: documents; each has one piece below `capacity` at most.

    Rows are dealt to tasks in turn, so no key can gather in one; a task holds the short pieces that it was
    dealt and packs them. Full pieces are sequences of their own and pass straight through.
    """
    tasks = max(1, -(-n_docs // PER_TASK))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, last = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            full = np.asarray(batch.column("length")) >= capacity
            if n := int(full.sum()):
                some = batch.filter(pa.array(full))
                yield placed(some, base + last + np.arange(n), np.zeros(n, np.int64))
                last += n
            if n < len(full):
                held.append(batch.filter(pa.array(~full)))
        if held:
            short = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets = best_two_fit(np.asarray(short.column("length")), capacity)
            yield placed(short, base + last + bins, offsets)

    def placed(batch: pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return pieces.repartition(tasks).mapInArrow(packed, schema)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ids and its place: the sequences are the pieces by sequence_id and offset."""
    return pack(tokenize(docs, vocabulary, capacity), docs.count(), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = tokenize(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, docs.count())
