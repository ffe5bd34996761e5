"""Collocations by Toivonen's mining.

A sample of stretches of the texts proposes phrases: those that are frequent there at a lowered threshold. One pass over all documents
counts these and their negative border: the phrases that aren't proposed but whose two phrases of one word less are. Nearly all of the
border is rare, so both of these count hashes in buckets (Park, Chen and Yu) and move no phrase: a bucket holds all counts of its phrases,
so that a frequent phrase's bucket is frequent. A last pass counts exactly, as words, the phrases of frequent buckets. If
some of the border is frequent, its extensions may be as well: this pass also counts every longer phrase that holds a failure of
the border and otherwise frequent ones, of all lengths at once, which closes the search. So every frequent phrase is counted,
whatever the sample held and whatever shares its bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, saved, small, table
from .hashing import mix

#: Share of the stretches of texts in the sample, one in so many, and their bytes.
SAMPLE, STRETCH = 4, 256
#: Bytes of texts counted together; bits a phrase in a filter, and bits of the smallest and the largest filter.
BLOCK, BITS, FILTER = 16 << 20, 32, (1 << 16, 1 << 27)
#: Bytes of text to a bucket of counts, and buckets of the smallest and the largest table of them; buckets added together.
PER_BUCKET, BUCKETS, RANGE = 8, (1 << 22, 1 << 40), 1 << 22
#: Hashes, and phrases, that a task packs together.
HASHES, PHRASES = 1 << 22, 1 << 20
#: Counts in buckets stop here at the latest.
ENOUGH = 1 << 20
#: Parts that a language's candidates are ranked in first.
PARTS = 64
LONGEST = 5
_GAMMA = np.uint64(0x9E3779B97F4A7C15)
#: What ends a piece becomes a full stop, tabs become spaces.
_SPLIT = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")


# --- filters


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * _GAMMA + word)


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(35)) & np.uint64(size - 1)).astype(np.int64)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: all that were put in, and few others."""
    size = len(bits) * 64
    found = np.ones(len(h), bool)
    for at in _bits(h, size):
        found &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def filter_of(phrases: DataFrame) -> np.ndarray:
    """A filter of the hashes of `phrases` (lang, phrase; or h, hashes), of BITS bits each and at most FILTER[1] in all, whatever their number: a
    fuller one lets more phrases be counted, it loses none. Tasks send its words of 64 bits, combined before they meet."""
    size = 1 << max(FILTER[0].bit_length() - 1, min(FILTER[1].bit_length() - 1, math.ceil(math.log2(max(1, phrases.count()) * BITS))))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.uint64] = {}
        for batch in batches:
            out = [batch.column("h").to_numpy().view(np.uint64)] if "h" in batch.schema.names else []
            for lang, phrase in [] if out else zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase"))):
                words = _word_hashes(phrase.encode().split(b" "))
                h = mix(words[:1] ^ known.setdefault(lang, _seed(lang)))
                for w in words[1:]:
                    h = _longer(h, w)
                out.append(h)
            at = np.concatenate(_bits(np.concatenate(out), size)) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["slot", "bits"])

    slots = phrases.select("h" if "h" in phrases.columns else ["lang", "phrase"]).mapInArrow(put, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return bits


class Filter(NamedTuple):
    """A filter of buckets: a phrase's bucket is the lowest bits of its hash."""

    bits: np.ndarray
    buckets: int

    def holds(self, h: np.ndarray) -> np.ndarray:
        return holds(self.bits, mix(h & np.uint64(self.buckets - 1)))


# --- counting


class Words:
    """Texts as numbers of their words, 0 between pieces, until BLOCK bytes are together. The next block begins with the last
    LONGEST - 1 words, so phrases across a cut are found where they end."""

    def __init__(self) -> None:
        self.begin([])

    def begin(self, before: list[bytes]) -> None:
        self.ids: dict[bytes, int] = {b".": 0}
        self.parts, self.skip, self.size = [], len(before), 0
        self.add(before)

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        self.parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))

    def block(self) -> tuple[np.ndarray, list[bytes], int]:
        """The words' numbers, what each number stands for, and how many words at the head were in the block before."""
        word, names, skip = np.concatenate(self.parts), list(self.ids), self.skip
        self.begin([names[i] for i in word[len(word) - LONGEST + 1 :].tolist()] if len(word) >= LONGEST else [names[i] for i in word.tolist()])
        return word, names, skip

    def put(self, text: bytes, block: int) -> Iterator[tuple[np.ndarray, list[bytes], int]]:
        """Add a text that _SPLIT has gone over; blocks that become full."""
        at = 0
        while at < len(text):
            cut = len(text)
            if at + block < cut:
                cut = max(text.rfind(b" ", at + 1, at + block), text.rfind(b".", at + 1, at + block))
                if cut < 0:  # a word longer than a block stays whole
                    cut = min((c for c in (text.find(b" ", at + block), text.find(b".", at + block)) if c >= 0), default=len(text))
            self.add(text[at:cut].replace(b".", b" . ").split())
            self.size += cut - at
            at = cut
            if self.size >= block:
                yield self.block()
        self.add([b"."])


def sampled(text: bytes, sample: int, row: int) -> bytes:
    """Stretches of whole words, one in `sample` by a hash of the row and the place: neither copies of a text nor repeats in it are
    sampled alike."""
    keep = mix(mix(np.array([row], np.uint64)) ^ np.arange(len(text) // STRETCH + 1, dtype=np.uint64)) % np.uint64(sample) == 0
    edge = lambda at: min((c for c in (text.find(b" ", at), text.find(b".", at)) if c >= 0), default=len(text)) if at else 0
    return b".".join([text[edge(i * STRETCH) : edge((i + 1) * STRETCH)] for i in np.flatnonzero(keep).tolist()])


def found_in(word: np.ndarray, names: list[bytes], skip: int, seed: np.uint64, lengths: tuple[int, ...], known: Filter | None, fresh: Filter | None, known_to: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, a place each, hashes and counts of a block's phrases of the `lengths` that don't end among the first `skip` words.

    A phrase of k words counts if both of its phrases of k - 1 words are in the filter `known` (if there is one; longer ones than
    `known_to` words pass). If there is a filter `fresh`, they may also hold one in it, and the phrase counts only if it is in
    `known` itself or holds a shorter one in `fresh`. Phrases are told apart by (number of the first k - 1 words, word).
    """
    own = word[skip:]
    yield 0, np.zeros(1, np.int64), np.zeros(1, np.uint64), np.array([np.count_nonzero(own)])
    counts = np.bincount(own, minlength=len(names))
    counts[0] = 0
    hashes = _word_hashes(names)
    here, h = np.where(word == 0, -1, word).astype(np.int64), mix(hashes ^ seed)
    some_known = None if known is None else known.holds(h)
    new = None if fresh is None else fresh.holds(h)  # phrases that hold a fresh one
    if 1 in lengths:
        place = np.zeros(len(names), np.int64)
        place[word[::-1]] = np.arange(len(word))[::-1]
        some = np.flatnonzero(counts > 0 if new is None else (counts > 0) & some_known)
        yield 1, place[some], h[some], counts[some]
    for k in range(2, max(lengths) + 1):
        good = here >= 0
        if known is not None and k - 1 <= known_to:
            good &= (some_known if new is None else some_known | new)[here]
        at = np.flatnonzero(good[:-1] & good[1:])
        if not len(at):
            return
        key = here[at] * len(names) + word[at + k - 1]
        order = np.argsort(key)
        first = np.diff(key[order], prepend=-1) != 0
        heads = np.flatnonzero(first)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(first) - 1
        place, key = at[order[heads]], key[order[heads]]  # where each phrase occurs, once
        head, last = key // len(names), key % len(names)
        longer = _longer(h[head], hashes[last])
        some_known = None if known is None else known.holds(longer)
        inner = None if new is None else new[head] | new[here[place + 1]]
        if k in lengths:
            counts = np.bincount(number[at + k - 1 >= skip], minlength=len(key))
            some = np.flatnonzero(counts > 0 if inner is None else (counts > 0) & (some_known | inner))
            yield k, place[some], longer[some], counts[some]
        if k < max(lengths):
            new = None if inner is None else inner | fresh.holds(longer)
            here, h = np.full(len(here) - 1, -1), longer
            here[at] = number


def counted(word: np.ndarray, names: list[bytes], skip: int, seed: np.uint64, lengths: tuple[int, ...], known: Filter | None, fresh: Filter | None, known_to: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, words (a row of numbers each) and counts of found_in()'s phrases, to look at."""
    for k, place, _, n in found_in(word, names, skip, seed, lengths, known, fresh, known_to):
        yield k, word[place[:, None] + np.arange(k)], n


def blocks(batches: Iterator[pa.RecordBatch], sample: int) -> Iterator[tuple[str, np.ndarray, list[bytes], int]]:
    """Language and block (see Words) of a task's texts, or of one stretch in `sample` of them."""
    held: dict[str, Words] = {}
    for batch in batches:
        for lang, text, row in zip(batch.column("lang"), batch.column("text"), batch.column("row").to_pylist()):
            lang, text = lang.as_py(), text.as_py().encode().lower().translate(_SPLIT)
            words = held.setdefault(lang, Words())
            for block in words.put(sampled(text, sample, row) if sample > 1 else text, BLOCK):
                yield lang, *block
            if len(held) > 1 and sum(w.size for w in held.values()) > BLOCK:  # few bytes of very many languages, or of some
                largest = max(held, key=lambda x: held[x].size)
                yield largest, *held.pop(largest).block()
    for lang, words in held.items():
        yield lang, *words.block()


def packed(keys: np.ndarray, shift: int, most: int) -> pa.RecordBatch:
    """Counts of buckets from `keys`, bucket << shift | count, a row for each RANGE of buckets: the lowest 16 bits of its buckets that have
    a count, in order; how many of them share the bits above; and the counts, `most` at most."""
    keys = np.sort(keys)
    at = keys >> np.uint64(shift)
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.minimum(np.add.reduceat(keys & np.uint64((1 << shift) - 1), heads), most).astype(np.min_scalar_type(most))
    part, at = np.divmod(at[heads].astype(np.int64), RANGE)
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    rows = [(int(part[i]), np.bincount(at[i:j] >> 16).astype(np.uint32).tobytes(), at[i:j].astype(np.uint16).tobytes(), n[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))], ["part", "sizes", "low", "n"])


def frequent_buckets(docs: DataFrame, lengths: tuple[int, ...], least: int, buckets: int, known: Filter | None = None, known_to: int = LONGEST, sample: int = 1) -> DataFrame:
    """h, border: buckets (as a filter takes them) whose phrases of `lengths` words, see found_in(), occur `least` times together in
    `docs` (lang, text), or in one stretch in `sample`. Phrases of fewer than LONGEST words that aren't in `known`, the border, have
    buckets of their own. Counts stop at `least`; a task sends three or so bytes a bucket, and a RANGE of buckets is added up in
    a task, so neither the rows nor the memory depend on how often a phrase occurs."""
    bounded_batches(docs.sparkSession)
    held = None if known is None else docs.sparkSession.sparkContext.broadcast(known)  # of a bounded size
    least = min(least, ENOUGH)
    shift, kind = least.bit_length(), np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if held is None else held.value
        keys: list[np.ndarray] = []
        for lang, word, names, skip in blocks(batches, sample):
            for k, _, h, n in found_in(word, names, skip, _seed(lang), lengths, own, None, known_to):
                if k and len(h):
                    at = h & np.uint64(buckets - 1)
                    if own is not None and k < LONGEST:
                        at[~own.holds(h)] += np.uint64(buckets)
                    keys.append(at << np.uint64(shift) | np.minimum(n, least).astype(np.uint64))
            if sum(map(len, keys)) >= HASHES:
                yield packed(np.concatenate(keys), shift, least)
                keys = []
        if keys:
            yield packed(np.concatenate(keys), shift, least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, above = None, np.zeros(RANGE, np.uint32), np.arange(RANGE >> 16) << 16

        def frequent() -> pa.RecordBatch:
            at = np.flatnonzero(counts >= least) + now * RANGE
            h = mix(at.astype(np.uint64) & np.uint64(buckets - 1)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(at >= buckets)], ["h", "border"])

        for batch in batches:
            for part, sizes, low, n in zip(*(batch.column(c).to_pylist() for c in ("part", "sizes", "low", "n"))):
                if part != now:
                    if now is not None:
                        yield frequent()
                    now = part
                    counts[:] = 0
                sizes = np.frombuffer(sizes, np.uint32)
                at = np.repeat(above[: len(sizes)], sizes) + np.frombuffer(low, np.uint16)  # each bucket once
                counts[at] = np.minimum(counts[at] + np.frombuffer(n, kind), least)
        if now is not None:
            yield frequent()

    docs = docs.select("lang", "text", F.monotonically_increasing_id().alias("row"))
    counts = docs.mapInArrow(count, "part long, sizes binary, low binary, n binary").repartition("part").sortWithinPartitions("part")
    return counts.mapInArrow(add, "h long, border boolean")


def summed(tables: list[pa.Table]) -> pa.Table:
    """phrase, h, n of all `tables`, a row a phrase."""
    return pa.concat_tables(tables).group_by(["phrase", "h"]).aggregate([("n", "sum")]).rename_columns(["phrase", "h", "n"])


def phrase_counts(docs: DataFrame, lengths: tuple[int, ...], least: int, buckets: int, known: Filter, fresh: Filter) -> DataFrame:
    """lang, k, phrase, n: counts of `least` or more of the phrases of `lengths` words in `docs` (lang, text), see found_in(); and
    with k = 0, phrase null, those of all words. A task adds up what its blocks hold, then sends its phrases packed in as many parts as there
    are RANGEs of buckets: in order, with a tab in between, which no phrase holds, and their counts."""
    bounded_batches(docs.sparkSession)
    sc, parts = docs.sparkSession.sparkContext, max(1, buckets // RANGE)
    known, fresh = sc.broadcast(known), sc.broadcast(fresh)  # of a bounded size

    def rows(lang: str, tables: list[pa.Table]) -> pa.RecordBatch:
        some = summed(tables)
        some = some.append_column("part", pa.array((some["h"].to_numpy() % np.uint64(parts)).astype(np.int64))).sort_by([("part", "ascending"), ("phrase", "ascending")])
        part, phrase, n = some["part"].to_numpy(), some["phrase"].combine_chunks(), some["n"].to_numpy()
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        out = [(lang, int(part[i]), "\t".join(phrase[i:j].to_pylist()), n[i:j].astype(np.min_scalar_type(n[i:j].max())).tobytes()) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.binary()))], ["lang", "part", "phrases", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        for lang, word, names, skip in blocks(batches, 1):
            strings, tables = pa.array(names, pa.binary()).cast(pa.string()), held.setdefault(lang, [])
            for k, place, h, n in found_in(word, names, skip, _seed(lang), lengths, known.value, fresh.value, LONGEST):
                phrase = pc.binary_join_element_wise(*(strings.take(pa.array(word[place + j])) for j in range(k)), " ") if k else pa.array([""])
                tables.append(pa.table({"phrase": phrase, "h": h, "n": n.astype(np.int64)}))
            if sum(t.num_rows for own in held.values() for t in own) >= PHRASES:
                for x, own in held.items():
                    yield rows(x, own)
                held = {}
        for x, own in held.items():
            yield rows(x, own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, []

        def frequent() -> pa.RecordBatch:
            some = summed(tables)
            some = some.filter(pc.or_(pc.greater_equal(some["n"], least), pc.equal(some["phrase"], "")))
            phrase = some["phrase"].combine_chunks()
            k = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
            lang = pa.array([now[0]] * len(phrase), pa.string())
            return pa.RecordBatch.from_arrays([lang, k, pc.if_else(pc.equal(phrase, ""), None, phrase), some["n"].combine_chunks()], ["lang", "k", "phrase", "n"])

        for batch in batches:
            for lang, part, phrases, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "phrases", "n"))):
                if (lang, part) != now:
                    if now is not None:
                        yield frequent()
                    now, tables = (lang, part), []
                phrases = pa.array(phrases.split("\t"), pa.string())
                n = np.frombuffer(n, f"u{len(n) // len(phrases)}").astype(np.int64)
                tables.append(pa.table({"phrase": phrases, "h": np.zeros(len(n), np.uint64), "n": n}))
                if sum(t.num_rows for t in tables[1:]) >= PHRASES:  # the first holds what has been added up
                    tables = [summed(tables)]
        if now is not None:
            yield frequent()

    docs = docs.select("lang", "text", F.monotonically_increasing_id().alias("row"))
    counts = docs.mapInArrow(count, "lang string, part long, phrases string, n binary").repartition("lang", "part").sortWithinPartitions("lang", "part")
    return counts.mapInArrow(add, "lang string, k int, phrase string, n long")


def proposed(docs: DataFrame, least: int, buckets: int, sample: int = SAMPLE) -> Filter:
    """Phrases of up to LONGEST - 1 words whose bucket is frequent in a sample of `docs`, one stretch in `sample` by a hash, at a threshold
    a deviation below nine tenths (phrases over an edge are lost) of what `least` would come to there."""
    low = max(1, math.floor(0.9 * least / sample - math.sqrt(least / sample)))
    found = saved(frequent_buckets(docs, (1, 2), low, buckets, sample=sample))
    longer = frequent_buckets(docs, tuple(range(3, LONGEST)), low, buckets, Filter(filter_of(found), buckets), 2, sample)
    return Filter(filter_of(found.unionByName(saved(longer))), buckets)


def frequent_phrases(docs: DataFrame, least: int, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, n of all phrases of up to LONGEST words that occur `least` times in a language of `docs` (lang, text); and the
    same with all words of a language, k = 0."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(1 << (size // PER_BUCKET).bit_length(), BUCKETS[0]), BUCKETS[1])
    lengths = tuple(range(1, LONGEST + 1))
    found = saved(frequent_buckets(docs, lengths, least, buckets, proposed(docs, least, buckets, sample)))
    # a frequent phrase not counted there holds a failure of the border, and its parts are in frequent buckets or hold one as well
    known, fresh = (Filter(filter_of(f), buckets) for f in (found, found.where("border")))
    out = saved(phrase_counts(docs, lengths, least, buckets, known, fresh))
    return out.where("k > 0"), out.where("k = 0")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `most` best phrases of 2 to LONGEST words that occur `least` times.

    `docs`: lang (null: `und`), text (null: empty); other columns aren't read, rows alike count as often as they occur. Texts, A to Z in
    lower case, are split into pieces at .,;:!? and line ends, and these into words at spaces and tabs; a phrase's words lie side
    by side in a piece. n counts all words of the language, a the phrase, l and r its parts before and after a cut; the cut of the
    lowest score floor(1000 a n / (l r)) counts, ties to the earliest. Phrases inside a longer candidate that occurs as often are left
    out. Order: score and a descending, phrase ascending by its bytes. An empty table gives an empty result.
    """
    docs = docs.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return ranked(*frequent_phrases(docs, least, sample), most)


def ranked(found: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """The result of collocations() from its phrases and totals, see frequent_phrases()."""
    found = saved(found.select("lang", "k", "phrase", F.col("n").alias("a")))
    size = found.count()
    candidates = found.where("k > 1")
    cuts = candidates.select("*", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, k), ' ')").alias("rest"))
    # beside one word that begins very many phrases Spark may split the join, as it moves both sides itself
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(small(found.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)), size), ["lang", part])
    totals = totals.select("lang", "n")
    cuts = cuts.join(small(totals, totals.count()), "lang")
    score = F.expr("CAST((CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0))) AS BIGINT)")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
    # a phrase occurs in all longer ones in between as often as in the longest, so those of one word more tell
    inner = F.explode(F.expr("array(array_join(slice(w, 1, k - 1), ' '), array_join(slice(w, 2, k - 1), ' '))")).alias("phrase")
    longer = candidates.where("k > 2").withColumn("w", F.split("phrase", " ")).select("lang", inner, F.col("a").alias("more"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    best = lowest.join(longer, ["lang", "phrase"], "left").where("more IS NULL OR more < a").select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT row_number() OVER () AS piece, * FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS text FROM d)),
w AS (SELECT lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, cut, array_to_string(s[1:cut], ' ') AS fst, array_to_string(s[cut + 1:], ' ') AS rst FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r, n, CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM c JOIN f x ON c.lang = x.lang AND c.fst = x.phrase JOIN f y ON c.lang = y.lang AND c.rst = y.phrase JOIN n ON c.lang = n.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
o AS (SELECT b.lang, b.phrase, a, l, r, n, score FROM b WHERE nth = 1 AND NOT EXISTS
      (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.k > b.k AND x.a >= b.a AND contains(concat(' ', x.phrase, ' '), concat(' ', b.phrase, ' ')))),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""
