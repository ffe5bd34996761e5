"""Spelling variants: words that differ by one code point, found with bidirectional FM-indexes.

A word and one near it agree in the first half of the word or in the second. Entries of the vocabulary are dealt by
these halves; a part of them, written with a delimiter around each word, gets an FM-index of the text and of the text
reversed. A search matches one half exactly from its delimiter on, then extends across the other half, where one error
may be spent, up to the other delimiter. Its state is an interval of suffix ranks in either index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small, table

#: Entries of an index, words searched at once, symbols of a rank block.
PER_INDEX, AT_ONCE, RANK = 20_000, 2048, 32
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
SPOILT = 97


# --- the index


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks of suffixes by doubling the length that they are compared in; the last symbol is the smallest and occurs once."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (max(n, int(rank.max()) + 1) + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Ranks:
    """How often each symbol occurs before a place of a Burrows-Wheeler transform: sums a block of RANK symbols and a look at the block."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        blocks = len(bwt) // RANK + 1
        self.rows = np.full((blocks, RANK), symbols, bwt.dtype)
        self.rows.ravel()[: len(bwt)] = bwt
        self.sums = np.zeros((blocks, symbols), np.int32)
        self.sums[1:] = np.bincount(np.arange(len(bwt)) // RANK * symbols + bwt, minlength=blocks * symbols).reshape(blocks, symbols)[:-1]
        np.cumsum(self.sums, axis=0, out=self.sums)
        self.less = np.cumsum(self.sums, axis=1) - self.sums
        self.symbols = symbols

    def of(self, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of c, and of smaller symbols, before `at`."""
        block, rest = at // RANK, np.arange(RANK) < (at % RANK)[:, None]
        row = self.rows[block]
        return self.sums[block, c] + ((row == c[:, None]) & rest).sum(1), self.less[block, c] + ((row < c[:, None]) & rest).sum(1)

    def all(self, at: np.ndarray) -> np.ndarray:
        """Occurrences of every symbol before `at`: a row each."""
        block, rest = at // RANK, np.arange(RANK) < (at % RANK)[:, None]
        i, j = np.nonzero(rest)
        return self.sums[block] + np.bincount(i * self.symbols + self.rows[block[i], j], minlength=len(at) * self.symbols).reshape(len(at), self.symbols)


class Index:
    """A bidirectional FM-index of delimited words: symbols 0 (the end), 1 (the delimiter) and letters from 2 on.

    A state (left, right, size) stands for `size` suffixes, from rank `left` on, that begin with a string, and as many of the
    reversed text, from rank `right` on, that begin with the string reversed.
    """

    def __init__(self, body: np.ndarray, symbols: int):
        self.ranks, self.symbols = [], symbols
        for side, text in enumerate((body, body[::-1])):
            text = np.append(text, 0).astype(np.uint8)
            order = suffix_array(text)
            if side == 0:
                self.places = order
            self.ranks.append(Ranks(text[order - 1], symbols))
        counts = np.bincount(np.append(body, 0), minlength=symbols)
        self.first, self.counts = np.cumsum(counts) - counts, counts

    def delimiters(self, n: int) -> np.ndarray:
        return np.repeat(np.array([[self.first[1]], [self.first[1]], [self.counts[1]]], np.int64), n, axis=1)

    def extend(self, state: np.ndarray, c: np.ndarray, side: int) -> np.ndarray:
        """The states of the strings with c added at the left (side 0) or the right (1); c below 0 occurs nowhere."""
        known = np.maximum(c, 0)
        (a, a_less), (b, b_less) = (self.ranks[side].of(known, state[side] + s) for s in (0, state[2]))
        out = np.empty_like(state)
        out[side], out[1 - side], out[2] = self.first[known] + a, state[1 - side] + b_less - a_less, np.where(c < 0, 0, b - a)
        return out

    def extensions(self, state: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All states of strings with one letter more that occur: the row each comes from, the letter, the states."""
        a, b = (self.ranks[side].all(state[side] + s) for s in (0, state[2]))
        n = b - a
        smaller = np.cumsum(n, axis=1) - n
        row, c = np.nonzero(n[:, 2:])
        c += 2
        out = np.empty((3, len(row)), np.int64)
        out[side], out[1 - side], out[2] = self.first[c] + a[row, c], state[1 - side, row] + smaller[row, c], n[row, c]
        return row, c, out


def one_error(index: Index, words: np.ndarray, half: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (rows of symbols of one length, in the order of the search) and places of the delimiters before the indexed words
    that agree in the first `half` symbols and differ by one symbol put in, left out or replaced after them."""
    n, length = words.shape
    state, row = index.delimiters(n), np.arange(n)

    def kept(row: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = state[2] > 0
        return row[some], state[:, some]

    for p in range(half):
        row, state = kept(row, index.extend(state, words[row, p], side))
    spent = (row[:0], state[:, :0])  # states with the error behind them
    for p in range(half, length + 1):
        of, c, more = index.extensions(state, side)
        if p < length:
            other = c != words[row[of], p]  # the letter itself put in here is as good put in after it
            of, more = of[other], more[:, other]
        spent = np.append(spent[0], row[of]), np.hstack([spent[1], more])  # put in
        if p == length:
            break
        on = kept(spent[0], index.extend(spent[1], words[spent[0], p], side))
        spent = np.concatenate([on[0], row[of], row]), np.hstack([on[1], more, state])  # and replaced, left out
        row, state = kept(row, index.extend(state, words[row, p], side))
        if not len(row) and not len(spent[0]):
            break
    row, state = kept(spent[0], index.extend(spent[1], np.ones(len(spent[0]), np.int64), side))
    return row, state[0]


def near_words(asked: list[str], listed: list[str], side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in `asked`, place in `listed`) of words at one error that agree in the asked word's first half (side 1), or in
    its second but not its first (side 0). All of `asked` have one length; `listed` holds no word twice."""
    points = lambda x: np.frombuffer("".join(x).encode("utf-32-le"), np.uint32)
    letters = np.unique(points(listed))
    sizes = np.array([len(w) for w in listed])
    body = np.ones(sizes.sum() + len(listed) + 1, np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1  # the delimiters before the words
    inside = np.ones(len(body), bool)
    inside[begins], inside[-1] = False, False
    body[inside] = np.searchsorted(letters, points(listed)) + 2
    index = Index(body, len(letters) + 2)
    length = len(asked[0])
    half = length // 2 if side else length - length // 2
    for at in range(0, len(asked), AT_ONCE):
        some = asked[at : at + AT_ONCE]
        at_letter = np.minimum(np.searchsorted(letters, p := points(some)), len(letters) - 1)
        words = np.where(letters[at_letter] == p, at_letter + 2, -1).reshape(len(some), length)
        row, rank = one_error(index, words if side else words[:, ::-1], half, side)
        found = np.unique(row * len(listed) + np.searchsorted(begins, index.places[rank]))
        row, word = found // len(listed), found % len(listed)
        if not side:  # what agrees in the first half is found from there
            first = words[:, : length // 2]
            body_at = begins[word, None] + 1 + np.arange(length // 2)
            other = (body[body_at] != first[row]).any(axis=1)
            row, word = row[other], word[other]
        yield at + row, word


# --- the tables


def words_of(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n: the runs of letters of `docs` (doc_id, text) in lower case A to Z, one in SPOILT without one of its code points, that
    have `least_length` code points and occur `least_n` times."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # shorter runs can't count: losing a code point makes none longer
    runs = docs.select(name.alias("name"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("name", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")))
    cut = "concat(substring(run, 1, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2))"
    words = runs.select(F.expr(f"CASE WHEN h % {SPOILT} = 0 THEN {cut} ELSE run END").alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def near_counts(words: DataFrame, per_index: int = PER_INDEX) -> DataFrame:
    """word, n_near, form_n, form: near words of each of `words` (word, n; no word twice) that has any, in parts to be added; the form
    is the one of largest n, ties to the smallest.

    A word of length L is listed for questions of length L - 1, L and L + 1 under its half that such a question would match, and
    asks under its own. Halves that more than `per_index` words share are dealt to a grid of blocks, so no task holds more of them.
    """
    sizes = F.expr("sequence(length(word) - 1, length(word) + 1)")
    listed = words.select("word", "n", F.explode(sizes).alias("size")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.expr("CASE WHEN side = 1 THEN left(word, size div 2) ELSE right(word, size - size div 2) END")
    listed = saved(listed.where("size > 0").select("word", "n", "size", "side", F.xxhash64(half).alias("half")))
    shares = listed.groupBy("size", "side", "half").agg(F.count(F.lit(1)).alias("many"))
    hot = saved(shares.where(F.col("many") > per_index).select("size", "side", "half", F.ceil(F.col("many") / per_index).cast("int").alias("blocks")))
    parts = max(1, -(-listed.count() // per_index))
    rows = listed.join(small(hot, hot.count()), ["size", "side", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    asks = F.expr("size = length(word)")
    every = F.expr("sequence(0, blocks - 1)")
    lists = rows.select("*", own.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("lists"), (asks & (F.col("blocks") == 1)).alias("asks"))
    more = rows.where(asks & (F.col("blocks") > 1)).select("*", F.explode(every).alias("i"), own.alias("j"), F.lit(False).alias("lists"), F.lit(True).alias("asks"))
    part = F.when(F.col("blocks") == 1, F.pmod("half", F.lit(parts))).otherwise(F.col("half")).alias("part")
    rows = lists.unionByName(more).select("size", "side", part, "i", "j", "word", "n", "lists", "asks")

    def searched(group: pa.Table) -> pa.Table:
        side = group.column("side")[0].as_py()
        listed_, asked = (group.filter(group.column(c)) for c in ("lists", "asks"))
        words_, asked = listed_.column("word").to_pylist(), asked.column("word").to_pylist()
        out: list[tuple] = []
        if asked and words_ and (len(words_) > 1 or words_ != asked):
            n = listed_.column("n").to_numpy()
            # places in the order of words: an order of strings by code points
            rank = np.empty(len(words_), np.int64)
            rank[sorted(range(len(words_)), key=words_.__getitem__)] = np.arange(len(words_))
            for row, word in near_words(asked, words_, side):
                order = np.lexsort((rank[word], -n[word], row))
                row, word = row[order], word[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                for k, count in zip(first.tolist(), np.diff(np.append(first, len(row))).tolist()):
                    out.append((asked[row[k]], count, int(n[word[k]]), words_[word[k]]))
        kinds = {"word": pa.string(), "n_near": pa.int64(), "form_n": pa.int64(), "form": pa.string()}
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(kinds.items())})

    return rows.groupBy("size", "side", "part", "i", "j").applyInArrow(searched, "word string, n_near long, form_n long, form string")


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of words_of(), with the number of near words, and the form of a word: its near
    word of largest n (ties: the smallest by code points), if that n is `times` the word's at least, else null. root is the
    last word that forms lead to from the word, itself if it has none.

    `docs`: doc_id (null: an empty name), text (null: no words); other columns aren't read. Rows alike count as often as
    they occur. An empty table gives an empty result. `times` is more than 1, so chains of forms end, after log n steps.
    """
    words = saved(words_of(docs, least_length, least_n))
    near = near_counts(words)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: bigint, form: string>").alias("best"))
    best = F.struct((-F.col("form_n")).alias("less"), "form").alias("best")
    found = none.unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "n_near", best))
    found = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.less") >= times * F.col("n")
    found = saved(found.select("word", "n", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    return found.join(roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(links: DataFrame) -> DataFrame:
    """word, root: where each word's link (word, root) ends, by rounds that double the way; links have no cycles."""
    while True:
        on = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = saved(links.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS h FROM r WHERE length(run) >= 5),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
      lambda c, x: xor(c >> 8, t.t[xor(c & 255, x) + 1]), 4294967295)) AS h FROM b, t),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM c)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT DISTINCT word, n, concat(left(word, i), substr(word, i + 2)) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
g AS (SELECT word, n, i, concat(left(word, i), chr(0), substr(word, i + 2)) AS gap FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT d.word, w.word AS near, w.n FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word
      UNION SELECT x.word, y.word, y.n FROM g x JOIN g y ON x.gap = y.gap AND x.word <> y.word),
a AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, (-n, near)) AS near FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN a ON w.word = a.word),
z AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT z.word, f.form, steps + 1 FROM z JOIN f ON z.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(root, steps) AS root, n, n_near, form_n FROM f JOIN z ON f.word = z.word GROUP BY ALL
"""
