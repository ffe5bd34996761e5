"""Vector operators against brute force."""

import numpy as np
import pytest

from tidegrid.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x") for i, v, lab in rows], SCHEMA)


def some(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:120] = x[50] + rng.normal(size=(70, d)).astype(np.float32) * 0.03
    x[130:140] = x[130]  # ties
    return x


BAD = [(900, None, 1), (901, [], 1), (902, [0.0] * 12, 1), (903, [None] + [1.0] * 11, 1), (904, [float("nan")] * 12, 1), (905, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (920, [1.0, 2.0], 1)]


def test_nearest(spark):
    x = some()
    # rows that share an id: 7 and 40 twice alike, 60 with another vector
    rows = [(i, v, i % 3) for i, v in enumerate(x)] + BAD + [(7, x[7], 1), (40, x[40], 1), (60, x[61], 1)]
    df = table(spark, rows)
    every = [(i, np.asarray(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 12 and all(t is not None and np.isfinite(t) for t in v) and any(v)]
    ids, xs = np.array([i for i, _ in every]), np.array([v for _, v in every])
    want = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = (xs * xs[at]).sum(1)
        s[at] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        want.append((int(ids[at]), ids[order].tolist(), pytest.approx(s[order].tolist(), rel=1e-12)))
    got = {}
    for r in vectors.nearest(df.where("vec_id % 20 = 0"), df).orderBy("query", "rank").collect():
        got.setdefault((r.query, r.query_id), []).append((r["rank"], r.vec_id, r.score))
    have = [(q, [i for _, i, _ in v], [s for *_, s in v]) for (_, q), v in got.items() if [r for r, *_ in v] == list(range(1, 21))]
    key = lambda t: (t[0], t[1])
    assert sorted(have, key=key) == sorted(want, key=key) and len(have) == 22


def test_nearest_of_unique_rows(spark):
    x = some()
    df = table(spark, [(i, v, i % 3) for i, v in enumerate(x)] + BAD)
    got = {}
    for r in vectors.nearest(df.where("vec_id % 20 = 0"), df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    xs = x.astype(float)
    for q in range(0, 400, 20):
        s = xs @ xs[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(400), -s))[:20]
        assert [i for i, _ in got[q]] == order.tolist()
        assert [v for _, v in got[q]] == pytest.approx(s[order].tolist(), rel=1e-12)
    assert sorted(got) == list(range(0, 400, 20)) and 920 not in got
    assert vectors.nearest(df.limit(0), df).count() == 0
    assert vectors.nearest(df.where("vec_id = 0"), df.where("vec_id < 6")).count() == 5


def test_tile_bounds_hold():
    x = some(300, 20, 3).astype(float)
    for q, ids, scores in vectors.tile_top(x[:40], np.arange(40), x, np.arange(300), 7, rows=16):
        s = x @ x[q]
        s[q] = -np.inf
        assert ids.tolist() == np.lexsort((np.arange(300), -s))[:7].tolist()


def test_copies_score_alike():
    rng = np.random.default_rng(5)
    for n in (66, 67, 302, 303, 2500):
        x = rng.normal(size=(40, 64)).astype(np.float32).astype(float)
        q, copy = x[:1], x[1]
        scores = []
        for copies in (n, 2, 1):  # tiles with many survivors and with few
            c = np.vstack([x[2:], np.repeat(copy[None], copies, 0)])
            ((_, ids, score),) = vectors.tile_top(q, np.array([-1]), c, np.arange(len(c)), len(c))
            scores += score[ids >= 38].tolist()
            assert ids[ids >= 38].tolist() == list(range(38, 38 + copies))
        assert len(set(scores)) == 1


def test_copies_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 256)
    rng = np.random.default_rng(6)
    copy = rng.normal(size=64).astype(np.float32)
    near = (copy + rng.normal(size=64) * 0.01).astype(np.float32)
    rows = [(i, copy if i % 2 else rng.normal(size=64) * 0.1, 1) for i in range(1, 1400)] + [(5000, near, 1)]
    df = table(spark, rows)
    got = vectors.nearest(df.where("vec_id = 5000"), df).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 41, 2)) and len({r.score for r in got}) == 1


@pytest.mark.parametrize("width", [2, 8])
def test_near_blocks(spark, width):
    rng = np.random.default_rng(8)
    low = np.sort(rng.uniform(0, 9, (37, 2)), axis=0)
    high = low + rng.uniform(0, 0.7, (37, 2))
    label = np.sort(rng.integers(0, 3, 37))
    rows = [(i, f"l{label[i]}", low[i].tolist(), high[i].tolist()) for i in range(37)]
    about = spark.createDataFrame(rows, "block long, label string, low array<double>, high array<double>")
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    near = ((gap**2).sum(-1) <= 0.25) & (label[:, None] == label[None])
    got = {(r.a, r.b) for r in vectors.near_blocks(about, 37, 2, 0.5, width).collect()}
    assert got == {(i, j) for i, j in np.argwhere(near).tolist() if i <= j}
    assert vectors.near_blocks(about.limit(0), 0, 2, 0.5).count() == 0


@pytest.mark.parametrize("least, block", [(0.98, 1024), (0.9, 1024), (0.9, 16)])
def test_near_vectors(spark, monkeypatch, least, block):
    monkeypatch.setattr(vectors, "ROWS", block)
    x = some()
    rows = [(i, v * (1 + i % 4), i % 2 if i < 350 else None) for i, v in enumerate(x)] + BAD + [(7, x[7], 1)]
    got = sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table(spark, rows), least).collect() if r.vec_id is not None)
    use = [r for r in rows if r[1] is not None and len(r[1]) == 12 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and r[2] is not None]
    u = np.array([r[1] for r in use], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in use])
    link = (u @ u.T >= least) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    comp = np.arange(len(use))
    while True:
        new = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(len(use))])
        if (new == comp).all():
            break
        comp = new
    ids = [r[0] for r in use]
    least_id = {c: min(i for i, k in zip(ids, comp) if k == c and i is not None) for c in set(comp) if any(i is not None for i, k in zip(ids, comp) if k == c)}
    want = [(False, i, int(n), least_id[c], i == least_id[c]) for i, n, c in zip(ids, link.sum(1), comp) if i is not None]
    want += [(False, r[0], 0, r[0], True) for r in rows if r[0] is not None and not any(r is x for x in use)]
    assert got == sorted(want)
    assert vectors.near_vectors(table(spark, [])).count() == 0
