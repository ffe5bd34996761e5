"""Phrase mining against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, a int, k string"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", text)]


def brute(rows, least, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = Counter({p: c for p, c in f.items() if c >= least})
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(x[0] == lang and len(x[1]) > len(p) and c >= a and any(x[1][i : i + len(p)] == p for i in range(len(x[1]) - len(p) + 1)) for x, c in f.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1))


def mined(spark, rows, least, most, sample):
    df = spark.createDataFrame([(1, t, lang, 0, "p", 1, "k") for lang, t in rows], SCHEMA)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(df, least, most, sample).collect())


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    fixed = ["new york city hall", "à la carte menu du jour", "one and one and one", "New York"]
    out = []
    for _ in range(n):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) if x < 300]
        for _ in range(rng.integers(0, 3)):
            words.insert(rng.integers(0, len(words) + 1), str(rng.choice(fixed)))
        sep = rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!\r\n"], len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        out.append((str(rng.choice(["en", "fr", ""])) or None, "".join(a + b for a, b in zip(words, sep))))
    return out


@pytest.mark.parametrize("least, most, sample", [(5, 2000, 2), (4, 7, 1_000_000), (9, 2000, 1), (3, 2000, 8)])
def test_against_brute_force(spark, least, most, sample):
    """Also with a sample that proposes nothing, so that every phrase comes from failures of the border."""
    rows = corpus(least) + [("en", None), (None, ""), ("und", "of the. of the! OF THE"), ("de", "aa aa aa aa aa aa aa aa aa"), ("de", ",;.")] + [("es", "mismo texto aquí")] * 12
    want = brute(rows, least, most)
    assert mined(spark, rows, least, most, sample) == want and len(want) > 10


def test_empty(spark):
    assert mined(spark, [], 3, 10, 8) == [] and mined(spark, [("en", None), (None, " .\t")], 1, 10, 1) == []


@pytest.mark.parametrize("block", [1, 7, 50, 10_000])
def test_blocks(block):
    """Texts cut into blocks hold each phrase once."""
    texts = [t for _, t in corpus(3, 20)] + ["", "x" * 40, "a b c d e f g h. i", "." * 30]
    got, want, words = Counter(), Counter(), phrases.Words()
    blocks = [b for t in texts for b in words.put(t.encode().lower().translate(phrases._SPLIT), block)] + [words.block()]
    assert len(blocks) > 10 or block > 50
    for word, names, skip in blocks:
        for k, rows, n in phrases.counted(word, names, skip, np.uint64(3), (1, 2, 3, 4, 5), None, None, 5):
            for r, c in zip(rows.tolist(), n.tolist()):
                got[k, b" ".join(names[i] for i in r)] += c
    for t in texts:
        for w in pieces(t):
            want[0, b""] += len(w)
            for k in range(1, 6):
                want.update((k, " ".join(w[i : i + k]).encode()) for i in range(len(w) - k + 1))
    assert got == want


def test_sample():
    text = b".".join(b"piece %d" % i for i in range(40000))
    some = phrases.sampled(text, 4, 1)
    assert some == phrases.sampled(text, 4, 1) != phrases.sampled(text, 4, 2) and 9000 < len(some.split(b".")) < 11_000 and phrases.sampled(b"", 4, 7) == b""
    assert set(some.replace(b".", b" ").split()) <= set(text.replace(b".", b" ").split())
    assert phrases.sampled(text, 1, 3).replace(b".", b" ").split() == text.replace(b".", b" ").split() and phrases.sampled(b"x" * 9999, 1, 3).strip(b".") == b"x" * 9999


def test_filter_loses_nothing(spark):
    rows = [("en" if i % 2 else "fr", f"w{i} w{i % 7}") for i in range(3000)]
    bits = phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"))
    h = lambda lang, p: phrases._longer(phrases.mix(phrases._word_hashes(p[:1]) ^ phrases._seed(lang)), phrases._word_hashes(p[1:]))
    assert all(phrases.holds(bits, h(lang, p.encode().split()))[0] for lang, p in rows)
    others = [phrases.holds(bits, h("de", p.encode().split()))[0] for _, p in rows]
    assert sum(others) < 100


def test_exact_arithmetic(spark):
    """Products beyond 64 bits."""
    found = spark.createDataFrame([("en", 1, "a", 4 * 10**12), ("en", 1, "b", 5 * 10**12), ("en", 2, "a b", 3 * 10**12)], "lang string, k int, phrase string, n long")
    totals = spark.createDataFrame([("en", 9 * 10**13 + 1)], "lang string, n long")
    (r,) = phrases.ranked(found, totals, 10).collect()
    assert r.score == 1000 * 3 * 10**12 * (9 * 10**13 + 1) // (20 * 10**24)


def shuffled(spark, job):
    """Bytes that `job` writes for shuffles."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none = sc._jvm.java.util.ArrayList()
        return sum(s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)))

    before = total()
    job()
    return total() - before


def test_rare_phrases_are_not_moved(spark):
    """Pairs of frequent words, nearly all of them rare: what moves is a few bytes a phrase of a task, not the phrase."""
    rng = np.random.default_rng(8)
    rows = [("en", " ".join(f"frequentword{x}" for x in rng.integers(0, 400, 500))) for _ in range(400)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    docs = spark.createDataFrame(docs.toArrow())  # so that only the search moves something
    rare = len({(a, b) for _, t in rows for a, b in zip(t.split(), t.split()[1:])})
    found = []
    bytes_moved = shuffled(spark, lambda: found.extend(phrases.frequent_phrases(docs, 100)[0].collect()))
    assert len(found) == 400 and rare > 100_000
    assert bytes_moved < 10 * rare
