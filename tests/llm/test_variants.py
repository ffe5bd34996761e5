"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, form string, side int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    found = {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        found[w] = (others[0][1] if others and -others[0][0] >= 2 * n[w] else None, len(others))
    out = []
    for w, (form, count) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(out, key=lambda r: r[0])


def found(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "w", 1, "f", 2) for d, t in rows], SCHEMA)
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.variants(df, **more).collect()), key=lambda r: r[0])


def texts(seed, letters, n=150):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list(letters), rng.integers(4, 12))) for _ in range(40)]
    out = []
    for d in range(n):
        words = []
        for s in rng.choice(stems, 60):
            for _ in range(rng.integers(0, 3)):
                i, c = rng.integers(0, len(s) + 1), rng.choice(list(letters))
                s = str(rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s]))
            words.append(s.title() if rng.random() < 0.2 else s)
        out.append((d, " ".join(words)))
    return out


@pytest.mark.parametrize("letters, per_index", [("ab", 20_000), ("abé", 50), ("abcdÿÀ", 20_000)])
def test_against_brute_force(spark, monkeypatch, letters, per_index):
    monkeypatch.setattr(variants.near_counts, "__defaults__", (per_index,))
    rows = texts(len(letters), letters) + [(None, None), (None, ""), (9, "aaaaaa aaaaaa"), (9, "aaaaaa aaaaaa"), (None, "aaaaa, aaaaaa; aaaaaaa"), (3, "x" * 300_000), (4, "x" * 300_000 + " " + "x" * 300_000), (5, "123 __ abab1abab")]
    want = brute([r for r in rows if len(r[1] or "") < 200_000])
    got = found(spark, rows)
    # giant words are words too
    assert [r for r in got if len(r[0]) < 200_000] == want and len(want) > 100
    assert sum(r[3] for r in got if len(r[0]) > 200_000) in (0, 3)


def test_hot_halves(spark):
    """Words that all begin alike: their half is dealt to a grid of blocks."""
    rng = np.random.default_rng(4)
    words = {"commonpart" + "".join(rng.choice(list("abc"), rng.integers(5, 8))) for _ in range(300)}
    df = spark.createDataFrame([(w, int(rng.integers(1, 9))) for w in sorted(words)], "word string, n long")
    have = {}
    for r in variants.near_counts(df, per_index=40).collect():
        have[r.word] = have.get(r.word, 0) + r.n_near
    assert have == {w: c for w in words if (c := sum(near(w, x) for x in words))}


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "a b c")]) == []


def test_intervals_hold():
    """Every interval of a bidirectional index is that of the occurrences, in either direction."""
    body = np.array([1, 2, 3, 2, 1, 3, 3, 2, 1, 2, 2, 1])
    index = variants.Index(body, 4)
    assert index.places.tolist() == sorted(range(13), key=lambda i: [*body[i:].tolist(), 0])
    state = index.delimiters(1)
    for c, side in ((2, 1), (3, 1), (2, 1), (1, 1)):
        state = index.extend(state, np.array([c]), side)
    assert state[2].tolist() == [1] and index.places[state[0, 0]] == 0
    state = index.delimiters(1)
    for c, side in ((2, 0), (3, 0), (1, 1)):
        state = index.extend(state, np.array([c]), side)
    assert state[2].tolist() == [0]


def test_roots(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(60)] + [("v", "w059")]
    got = variants.roots(spark.createDataFrame(chain, "word string, root string")).collect()
    assert {r.root for r in got} == {"w060"} and len(got) == 61
