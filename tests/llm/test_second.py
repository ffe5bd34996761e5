"""Second implementations, in plain Python, of what SQL can't express: the Feistel network, pivotal rounding, resampling, the pipeline."""

import hashlib
import math
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
import xxhash
from test_documents import dedup_by_hand, docs, words

from tidegrid.llm import mixing, privacy, quality

M64 = 2**64 - 1


def spark_hash(*values):
    """Spark's xxhash64 of 32-bit numbers (given as a one-tuple), 64-bit numbers and strings; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - 2**64 if h >= 2**63 else h


# --- pseudonyms


def permuted(symbols, radices, kind, key="tidegrid", back=False):
    half = len(radices) // 2
    sides, limits = [list(symbols[:half]), list(symbols[half:])], [radices[:half], radices[half:]]
    for r in reversed(range(8)) if back else range(8):
        own, other = sides[r % 2], ",".join(map(str, sides[1 - r % 2]))
        for i, m in enumerate(limits[r % 2]):
            shift = int(hashlib.sha256(f"{key}|{kind}|{r}|{i}|{other}".encode()).hexdigest()[:12], 16)
            own[i] = (own[i] + (-shift if back else shift)) % m
    return sides[0] + sides[1]


def within_classes(text, classes, kind):
    own = [next((c for c in classes if x in c), "") for x in text]
    new = iter(permuted([c.index(x) for x, c in zip(text, own) if c], [len(c) for c in own if c], kind))
    return "".join(c[next(new)] if c else x for x, c in zip(text, own))


def digits_into(text, digits):
    new = iter(digits)
    return re.sub(r"\d", lambda _: str(next(new)), text)


def check_digit(digits):
    return -sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def ssn_of(value):
    a, b, c = map(int, value.split("-"))
    a, b, c = permuted([a - (2 if a > 666 else 1), b - 1, c - 1], [898, 99, 9999], "ssn")
    return f"{a + (2 if a > 664 else 1):03}-{b + 1:02}-{c + 1:04}"


def day_of(value):
    n = (date.fromisoformat(value) - date(1850, 1, 1)).days
    a, b = permuted(list(divmod(n, 365)), [300, 365], "date")
    return str(date(1850, 1, 1) + timedelta(days=a * 365 + b))


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def test_feistel_by_hand(spark):
    rng = np.random.default_rng(5)
    n = lambda a, b: int(rng.integers(a, b))
    rows, want = [], []

    def add(before, value, new):
        rows.append((len(rows), f"{before} {value} here", "en", "a"))
        want.append(f"{before} {new} here")

    for _ in range(25):
        ip = [n(0, 256) for _ in range(4)]
        add("at", ".".join(map(str, ip)), ".".join(map(str, permuted(ip, [256] * 4, "ip"))))
        ssn = f"{n(1, 666):03}-{n(1, 100):02}-{n(1, 10000):04}"
        add("no", ssn, ssn_of(ssn))
        day = str(date(1850, 1, 1) + timedelta(days=n(0, 300 * 365)))
        add("on", day, day_of(day))
        tel = f"+{n(1, 999)} {n(100, 999)} {n(100, 999)} {n(1000, 9999)}"
        d = [int(c) for c in tel if c.isdigit()]
        add("tel", tel, digits_into(tel, d[:-10] + permuted(d[-10:], [10] * 10, "phone")))
        card = [4, *(n(0, 10) for _ in range(14))]
        card.append(check_digit(card))
        new = [4, *permuted(card[1:-1], [10] * 14, "card")]
        add("pay", "".join(map(str, card)), "".join(map(str, [*new, check_digit(new)])))
        local = "".join(rng.choice(list(LOWER + DIGITS + "AZ"), 9)) + ".b_1"
        add("to", f"{local}@mail.example.org", within_classes(local, [DIGITS, LOWER, LOWER.upper()], "email") + "@mail.example.org")
        key = "".join(rng.choice(list(DIGITS + LOWER.upper()), 16))
        add("key", "AKIA" + key, "AKIA" + within_classes(key, [DIGITS, LOWER.upper()], "secret"))
        hexa = "".join(rng.choice(list(DIGITS + "abcdef"), 24))
        add("token =", hexa, within_classes(hexa, [DIGITS + "abcdef"], "hex"))
        assert permuted(permuted(ip, [256] * 4, "ip"), [256] * 4, "ip", back=True) == ip
    got = {r.doc_id: r.text for r in privacy.pseudonymised(docs(spark, rows), "tidegrid").collect()}
    assert [got[i] for i in range(len(rows))] == want


# --- mixing


def targets_by_hand(sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest, share = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        want = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and want[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return want
        full |= over


def rounded_by_hand(units, seed):
    """Units are [key, size, mass]; pairs exchange mass until one is whole. The whole ones, and the one left or None."""
    cur, done = None, []
    for e in units:
        if cur is None or cur[2] <= 0 or cur[2] >= cur[1]:
            done += [cur] if cur else []
            cur = e
            continue
        a, coin = cur, (spark_hash((seed,), cur[0], e[0]) % 2**30 + 0.5) / 2**30
        give, take = min(a[2], e[1] - e[2]), min(a[1] - a[2], e[2])
        moved, towards_e = (give, True) if coin * (give + take) < take else (take, False)
        a_whole = moved == (a[2] if towards_e else a[1] - a[2])
        if a_whole:
            e[2] += moved if towards_e else -moved
            a[2] = 0.0 if towards_e else float(a[1])
            done, cur = [*done, a], e
        else:
            a[2] += -moved if towards_e else moved
            e[2] = float(e[1]) if towards_e else 0.0
            done, cur = [*done, e], a
    return done, cur


def copies_by_hand(rows, seed=7):
    """rows: doc_id, source, size -> copies of each distinct row."""
    n, totals = Counter(rows), Counter()
    for (_, s, size), k in n.items():
        totals[s] += size * k
    target, copies, open_ = targets_by_hand(totals), {}, {}
    for (did, s, size), k in n.items():
        want = k * target[s] / totals[s] if size else 0.0
        unit = [spark_hash((seed,), did, s, size), size, (want - math.floor(want)) * size, (did, s, size)]
        copies[did, s, size] = math.floor(want)
        open_.setdefault(s, []).append(unit) if 0 < unit[2] < size else None
    docs_of = Counter(s for _, s, _ in n)
    levels = max(1, math.ceil(math.log(max(2, *docs_of.values()), 128)))
    for s, left in open_.items():
        room, whole = math.ceil(docs_of[s] / 128), []
        for level in range(levels):
            blocks = {}
            for u in left:
                blocks.setdefault(spark_hash((level,), (seed,), u[0]) % max(1, room), []).append(u)
            done = [rounded_by_hand(sorted(b, key=lambda u: u[0]), seed + level) for b in blocks.values()]
            whole, left, room = whole + [u for d, _ in done for u in d], [c for _, c in done if c], math.ceil(room / 128)
        for u in left:
            u[2] = float(u[1]) if u[2] * 2 >= u[1] else 0.0
        for u in whole + left:
            copies[u[3]] += u[2] >= u[1]
    return copies


def test_rounding_by_hand(spark):
    rows = [(i, words(i, 5 + i % 50), "en", f"s{i % 4}") for i in range(700)] + [(1000 + i, words(i, 9), "en", None) for i in range(30)] + [(5000, words(1, 12), "en", "s1")] * 7 + [(None, "one two", "en", "s2")] * 2
    got = {(r.doc_id, r.source, r["size"]): r["copies"] for r in mixing.mix(docs(spark, rows)).collect()}
    assert got == copies_by_hand([(d, s, len(t.split())) for d, t, _, s in rows])
    assert len(set(got.values())) > 2


# --- resampling


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def word_hash(word):
    return mixed(sum(mixed((c + 1) * 0x9E3779B97F4A7C15 & M64) * pow(0x100000001B3, i + 1, 2**64) for i, c in enumerate(word)) & M64)


def test_resampling_by_hand(spark):
    rows = [(i, words(i, 3 + i % 60, 80 if i % 3 else 900), "en", "a") for i in range(240)] + [(500, None, "en", "a"), (501, " \n", "en", "a"), (7, "again another text", "en", "b")]
    good = {i for i in range(240) if i % 3 and i % 2}
    grams = []
    for _, t, *_ in rows:
        w = [word_hash(x) for x in (t or "").encode().split()]
        grams.append([g % quality.BUCKETS for g in [mixed(x) for x in w] + [mixed((a * 0x9E3779B97F4A7C15 + b) & M64) for a, b in zip(w, w[1:])]])
    raw, target = Counter(g for gs in grams for g in gs), Counter(g for gs, r in zip(grams, rows) if r[0] in good for g in gs)
    spread = [sum(c.values()) + quality.BUCKETS / 2 for c in (target, raw)]
    want = {}
    for (did, t, *_), gs in zip(rows, grams):
        if gs:
            ratio = sum(math.log((target[g] + 0.5) / spread[0]) - math.log((raw[g] + 0.5) / spread[1]) for g in gs)
            u = (spark_hash((11,), did, t) % 2**52 + 0.5) / 2**52
            want[did, len(gs)] = ratio, ratio - math.log(-math.log(u))
    best = sorted((s for _, s in want.values()), reverse=True)[math.ceil(0.6 * len(want)) - 1]
    got = quality.resampled(docs(spark, rows), spark.createDataFrame([(i,) for i in good], "doc_id long"), share=0.6).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.score is None:
            assert r.n_grams == 0 and not r.selected
        else:
            ratio, score = want[r.doc_id, r.n_grams]
            assert (r.log_ratio, r.score) == pytest.approx((ratio, score), abs=1e-6)
            assert r.selected == (score >= best)
    assert sum(r.selected for r in got) == math.ceil(0.6 * len(want))


# --- pipeline


def one_of_each_by_hand(rows):
    """The row with the smallest doc_id of each group linked by multisets of five words with similarity 0.8 or more."""
    cut = [t.split() for _, t, _ in rows]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in cut]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                group = [group[j] if g == group[i] else g for g in group]
    return [min(r for r, g in zip(rows, group) if g == one) for one in sorted(set(group))]


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    passage = "\n".join(f"a line of passage {i}" for i in range(12))
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "12 345 !", None, "b"), (4, words(4, 3000), None, "a"), (5, f"head\n{passage}\ntail", None, "a"), (6, f"other\nstart\n{passage}\nend\nof", None, "b"), (7, passage, None, "c")]
    for g in range(25):
        base = words(50 + g, 60 + g).split()
        for k in range(1 + g % 3):
            rows.append((100 + 10 * g + k, " ".join([*base[: 30 + k], *base[31 + k :]]), None, "abc"[(g + k) % 3] if g % 5 else None))
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # nothing is labelled, so all texts with a letter pass the first stage
    docs_ = [r for r in rows if re.search("[a-z]", r[1] or "")]
    source = {r[0]: r[3] for r in docs_}
    kept = [(d, t) for d, _, gone, t in dedup_by_hand(docs_) if not gone or t.strip()]
    kept = [(d, t) for d, t, _ in one_of_each_by_hand([(d, t, 0) for d, t in kept])]
    copies = copies_by_hand([(d, source[d], len(t.split())) for d, t in kept])
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for d, t in kept:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        starts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[d, i, a, tuple(ids[a:b])] += copies[d, source[d], len(t.split())]
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in got) == +want
    assert len({d for d, *_ in want}) < len(docs_) and max(want.values()) > 1
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(b[-1]) <= 1024
