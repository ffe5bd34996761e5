"""Language identification by a convolutional network over bytes, trained in numpy.

The network looks at a window of bytes: filters of two, three and four bytes over byte embeddings, the largest
response of each filter in the window, and a softmax layer. A text is cut into windows of one length, whole
texts only; their probabilities are averaged by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW, WIDTHS, FILTERS, EMBEDDING = 512, (2, 3, 4), 8, 8
#: Labelled rows that training may use, per language and in all.
PER_LANGUAGE, TRAIN_ROWS = 400, 8000
UNKNOWN = "und"
#: ISO 639's code for no linguistic content, and its mean probability from which known_language() rejects a text.
NO_LANGUAGE, NOISE = "zxx", 0.95


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # for each width: width x EMBEDDING x FILTERS
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray


def windows(text: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `size` bytes (the last filled with spaces) that cover a text, and the bytes each holds."""
    n = max(1, -(-len(text) // size))
    out = np.frombuffer(text.ljust(n * size, b" "), np.uint8).reshape(n, size)
    return out, np.minimum(size, len(text) - size * np.arange(n))


def train(texts: list[bytes], labels: list[str], epochs: int = 14, seed: int = 3, rate: float = 0.01) -> Network:
    """Adam on the cross-entropy of windows of the texts."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    cut = [windows(t) for t in texts]
    x = np.concatenate([w[n > 40] if (n > 40).any() else w[:1] for w, n in cut])
    y = np.repeat([languages.index(v) for v in labels], [max(1, int((n > 40).sum())) for _, n in cut])
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    weight *= len(y) / weight.sum()
    k = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.5, (256, EMBEDDING)), *(rng.normal(0, 0.5 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS), np.zeros(k), rng.normal(0, 0.3, (k, len(languages))), np.zeros(len(languages))]
    p = [v.astype(np.float32) for v in p]
    m, v2, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            b = x[at]
            e = p[0][b]
            pooled, where = [], []
            for f, w in zip(p[1:4], WIDTHS):
                n = b.shape[1] - w + 1
                r = sum(e[:, i : i + n] @ f[i] for i in range(w))
                best = r.argmax(axis=1)
                where.append(best)
                pooled.append(np.take_along_axis(r, best[:, None], 1)[:, 0])
            h = np.maximum(0, np.concatenate(pooled, axis=1) + p[4])
            z = h @ p[5] + p[6]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = z / z.sum(axis=1, keepdims=True)
            d[np.arange(len(at)), y[at]] -= 1
            d *= (weight[at] / len(at))[:, None].astype(np.float32)
            g = [np.zeros_like(v) for v in p]
            g[5], g[6] = h.T @ d, d.sum(0)
            dh = (d @ p[5].T) * (h > 0)
            g[4] = dh.sum(0)
            for k2, (f, w, best) in enumerate(zip(p[1:4], WIDTHS, where)):
                dk = dh[:, k2 * FILTERS : (k2 + 1) * FILTERS]
                rows = np.arange(len(at))[:, None]
                for i in range(w):
                    own = e[rows, best + i]  # rows x FILTERS x EMBEDDING
                    g[1 + k2][i] = np.einsum("nfe,nf->ef", own, dk)
                    np.add.at(g[0], b[rows, best + i], dk[:, :, None] * f[i].T[None])
            step += 1
            for j in range(len(p)):
                m[j] = 0.9 * m[j] + 0.1 * g[j]
                v2[j] = 0.999 * v2[j] + 0.001 * g[j] ** 2
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v2[j] / (1 - 0.999**step)) + 1e-8)
                p[j] = p[j].astype(np.float32)
    return Network(languages, p[0], p[1:4], p[4], p[5], p[6])


class Predictor:
    """Probabilities of windows. Responses come from tables of byte pairs, in fixed point, 16 bytes an entry."""

    def __init__(self, net: Network):
        self.net = net
        one = [[net.embedding @ f[i] for i in range(w)] for f, w in zip(net.filters, WIDTHS)]
        most = max(sum(np.abs(t).max() for t in ts) for ts in one)
        self.scale = 16000 / max(most, 1e-9)
        pair = lambda a, b: np.rint((a[:, None] + b[None, :]).reshape(65536, -1) * self.scale).astype(np.int16)
        two, three, four = one
        zero = np.zeros_like(three[2])
        self.first = [self._packed(pair(t[0], t[1])) for t in one]
        self.second = [None, self._packed(pair(three[2], zero)), self._packed(pair(four[2], four[3]))]

    @staticmethod
    def _packed(t: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(t).view(np.complex128)[:, 0]  # a row of eight 16-bit numbers moves at once

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x: windows x bytes."""
        b = np.ascontiguousarray(x.T).astype(np.uint16)
        codes = (b[:-1] << 8) | b[1:]
        pooled = []
        for i, w in enumerate(WIDTHS):
            n = len(b) - w + 1
            r = self.first[i][codes[:n]].view(np.int16).reshape(n, -1)
            if w > 2:
                # the third width reads one byte more; its table ignores it, and the last one repeats itself
                c = codes[2 : 2 + n] if w == 4 else np.vstack([codes[2:], b[-1:] << 8])[:n]
                r = r + self.second[i][c].view(np.int16).reshape(n, -1)
            pooled.append(r.max(axis=0).reshape(-1, FILTERS))
        h = np.maximum(0, np.concatenate(pooled, axis=1) / self.scale + self.net.bias)
        z = h @ self.net.out + self.net.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def noise(n: int, seed: int = 3) -> list[bytes]:
    """Texts with letters and without language: hexadecimal dumps, base64, printable characters at random."""
    rng = np.random.default_rng(seed)
    kinds = [b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(33, 127))]
    out = []
    for i in range(n):
        own = np.frombuffer(kinds[i % 4], np.uint8)
        text = own[rng.integers(0, len(own), int(2 ** rng.uniform(6, 10)))].tobytes()
        step = int(rng.choice([2, 4, 8, 16, 32, 64, 76, 2 * WINDOW]))
        gap = b"\n" if step in (64, 76) else b" "
        out.append(gap.join(text[a : a + step] for a in range(0, len(text), step))[: 2 * WINDOW])
    return out


def with_noise_inside(texts: list[bytes], seed: int = 3) -> list[bytes]:
    """Every other text with noise in each of its pieces of 200 bytes, every other of these in upper case; the others as they are."""
    rng = np.random.default_rng(seed)
    out = list(texts)
    for i, odd in zip(range(1, len(texts), 2), noise(len(texts), seed + 1)):
        text = texts[i].decode(errors="ignore")
        text = (text.upper() if i % 4 == 3 else text).encode()
        n = int(rng.integers(10, 120))
        out[i] = b" ".join(text[a : a + 200] + b" " + odd[:n] for a in range(0, len(text), 200))[: 2 * WINDOW]
    return out


def fit(docs: DataFrame, seed: int = 3, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS, with_noise: bool = False) -> Network | None:
    """Train on the rows of `docs` (doc_id, text, lang) with text and lang: at most `per_language` windows of
    each language, each from another text at a place that a hash chooses, and at most `rows` in all.

    None if there are no such rows. The driver gets the sampled windows only. With noise, `zxx` is a language
    of its own, trained on as many made texts as the commonest one has, and half of the texts get some noise inside, so that
    a text with a passage of noise counts as language.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    raw = F.col("text").cast("binary")
    length = 2 * WINDOW
    place = (F.pmod(F.shiftright(key, 7), F.greatest(F.octet_length("text") - length, F.lit(0)) + 1) + 1).cast("int")
    some = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(has_letter("text"))
    some = some.select(F.col("lang").cast("string").alias("lang"), key.alias("k"), F.pmod(key, F.lit(per_language)).alias("slot"), F.substring(raw, place, F.lit(length)).alias("w"))
    some = some.groupBy("lang", "slot").agg(F.min("k").alias("k"), F.min_by("w", "k").alias("w"))
    got = some.orderBy(F.xxhash64("k"), "lang").limit(rows).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, r.k))
    texts, labels = [bytes(r.w) for r in got], [r.lang for r in got]
    if with_noise:
        more = noise(max(map(labels.count, set(labels))), seed)
        texts, labels = with_noise_inside(texts, seed) + more, labels + [NO_LANGUAGE] * len(more)
        return train(texts, labels, epochs=max(14, min(100, 20_000 // len(texts))), seed=seed)  # small tables: as many steps
    return train(texts, labels, seed=seed)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of `docs` with lang_pred and score, the mean probability, from text alone.

    Text that is null or has no letter gets `und` and score 0, as does every text without a network. Very
    long texts pass in blocks of windows. Rows are judged one by one: repeats get equal results.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double"
    block = 2048

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Predictor(net) if net else None
        for batch in batches:
            texts, letters = batch.column("_text"), batch.column("_letter").to_pylist()
            total = np.zeros((len(texts), len(net.languages) if net else 1))
            waiting, held = [], 0

            def flush() -> None:
                nonlocal waiting, held
                if waiting:
                    x = np.concatenate([w for _, w, _ in waiting])
                    n = np.concatenate([n for _, _, n in waiting])
                    row = np.repeat([i for i, _, _ in waiting], [len(n) for _, _, n in waiting])
                    for a in range(0, len(x), block):
                        np.add.at(total, row[a : a + block], model(x[a : a + block]) * n[a : a + block, None])
                waiting, held = [], 0

            if model:
                for i, t in enumerate(texts):
                    if letters[i]:
                        w, n = windows(t.as_py().encode())
                        waiting.append((i, w, n))
                        held += len(w)
                        if held >= block:
                            flush()
                flush()
            sums = total.sum(axis=1)
            known = sums > 0
            p = total / np.where(known, sums, 1)[:, None]
            best = p.argmax(axis=1)
            names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(names, pa.string()), pa.array(np.minimum(1.0, score))], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").alias("_text"), has_letter("text").alias("_letter"))
    return rows.mapInArrow(judged, schema)


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that hold language; those without text or letters are rejected, and those that the network
    takes for noise with a mean probability of NOISE at least. Nothing to train on: all with letters stay.
    """
    some = docs.where(has_letter("text"))
    net = fit(docs, with_noise=True)
    if not net:
        return some
    inner = some.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(docs.columns)}).withColumn("text", F.col(f"_{docs.columns.index('text')}"))
    judged = predict(inner, net, tuple(f"_{i}" for i in range(len(docs.columns))))
    judged = judged.where((F.col("lang_pred") != NO_LANGUAGE) | (F.col("score") < NOISE))
    return judged.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    docs = docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    net = fit(docs.where(fold != 2))
    return predict(docs, net, ("doc_id", "held_out"))
