"""Embedding links against all pairs."""

import random
from collections import Counter

import numpy as np

from corpusq.llm import forest
from corpusq.plans.workspace import Workspace


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids = sorted({(i, v.tobytes()) for i, v in ok})
    vecs = [np.frombuffer(b) / np.abs(np.frombuffer(b)).max() for _, b in ids]
    vecs = [v / np.linalg.norm(v) for v in vecs]
    links = {k: set() for k in ids}
    for x in range(len(ids)):
        for y in range(x):
            if len(vecs[x]) == len(vecs[y]) and vecs[x] @ vecs[y] >= 0.95:
                links[ids[x]].add(ids[y])
                links[ids[y]].add(ids[x])
    comp = {}
    for k in ids:
        if k not in comp:
            todo = [k]
            while todo:
                c = todo.pop()
                if c not in comp:
                    comp[c] = k[0]
                    todo += links[c]
    out = []
    for i, v in rows:
        k = (i, np.array(v, float).tobytes()) if v and None not in v else None
        n, c = (len(links[k]), comp[k]) if k in links else (0, i)
        out.append((i, n, c, i is not None and c == i))
    return out


def group(rng, base, n, noise):
    return [list(map(float, base + noise * rng.standard_normal(len(base)))) for _ in range(n)]


def check(spark, rows):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = [tuple(r) for r in forest.near_duplicates(frame, Workspace(spark, "rp")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    return got


def test_groups_and_odd_rows(spark, monkeypatch):
    for name, value in (("LEAF", 40), ("BLOCK", 64), ("SAMPLE", 500)):
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(1)
    vecs = [list(map(float, v)) for v in rng.standard_normal((500, 32))]
    for n in (2, 3, 30, 200):
        vecs += group(rng, rng.standard_normal(32), n, 0.13)
    vecs += [vecs[0], vecs[0], [2 * x for x in vecs[1]]]
    vecs += [None, [], [0.0] * 32, [float("nan")] * 32, [None, *vecs[0][1:]], [1e300, 1e300], [1.0, 1.0], [1.0] * 3, [float("inf"), 1.0]]
    random.Random(0).shuffle(vecs)
    rows = list(enumerate(vecs)) + [(None, vecs[0]), (3, vecs[3]), (3, vecs[3])]
    check(spark, rows)


def test_chain_and_empty(spark):
    rng = np.random.default_rng(2)
    a, b = np.eye(16)[0], np.eye(16)[1]
    chain = [list(map(float, np.cos(t) * a + np.sin(t) * b)) for t in np.arange(0, 3, 0.2)]
    got = check(spark, [(100 - i, v) for i, v in enumerate(chain)] + [(200 + i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((50, 16)))])
    assert {r[2] for r in got if r[0] <= 100} == {100 - len(chain) + 1}
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert forest.near_duplicates(frame, Workspace(spark, "rp")).count() == 0


def planted(rng, n, dim, low=0.95, high=0.97):
    """Random unit vectors, and for every tenth one at a cosine between low and high to it."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x[::10]
    side = rng.standard_normal(near.shape)
    side -= (side * near).sum(axis=1)[:, None] * near
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(low + 1e-6, high, len(near))[:, None]
    return np.concatenate([x, c * near + np.sqrt(1 - c * c) * side])


def recall(spark, x, expected=None):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = np.zeros(len(x), int)
    for r in forest.near_duplicates(frame, Workspace(spark, "rp")).collect():
        got[r.vec_id] = r.n_links
    want = np.concatenate([(x[i : i + 1000] @ x.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(x), 1000)])
    assert (got <= want).all() and want.sum() > 0
    return got.sum() / want.sum()


def test_recall_of_planted_pairs(spark):
    assert recall(spark, planted(np.random.default_rng(8), 6000, 32)) >= 0.99


def test_large_leaves_are_split_again(spark, monkeypatch):
    for name, value in (("SAMPLE", 200), ("LEAF", 40), ("MOST", 150), ("SUB_SAMPLE", 100), ("SPLITS", 3), ("BLOCK", 64)):
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(9)
    x = planted(rng, 3000, 24)
    near = rng.standard_normal(24)
    x = np.concatenate([x, near / np.linalg.norm(near) + 0.01 * rng.standard_normal((300, 24))])  # a leaf that can't be split
    x /= np.linalg.norm(x, axis=1)[:, None]
    ws = Workspace(spark, "deep")
    vectors = [(i, 1, 24, v.astype("<f8").tobytes(), [5, 6] if i % 2 else [5]) for i, v in enumerate(x)]
    routed = spark.createDataFrame(vectors, "node long, copies long, dim int, raw binary, leaves array<long>")
    sizes = Counter(leaf for r in forest.deepen(routed, ws).collect() for leaf in r.leaves)
    assert len(sizes) > 40 and sorted(sizes.values())[-8] <= 400 and sum(sizes.values()) > 4500
    assert recall(spark, x) >= 0.97
    monkeypatch.setattr(forest, "ROUNDS", 1)
    assert {r.node for r in forest.deepen(routed, ws).collect()} == set(range(len(x)))
