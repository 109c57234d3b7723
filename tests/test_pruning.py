"""Parities never prune a similar pair, and prune nearly all others."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.operators import duplicates
from corpusq.operators.duplicates import possible, shared_elements, trigrams
from corpusq.plans.workspace import Workspace


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.5, 0.8, 0.9]), st.sampled_from([1, 5, 60, 700]))
def test_no_similar_pair_is_pruned(seed, threshold, size):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    sets = [base]
    for share in (0.02, 0.1, 0.11, 0.2, 0.4):
        kept = base[rng.random(len(base)) >= share]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 1 << 63, int(share * len(base) * rng.random()) + 1, dtype=np.uint64)))))
    ask = possible(sets, sets, threshold)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert ask[i, j] or jaccard(a, b) < threshold


def test_few_comparisons_are_left(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(200)]
    texts += [t.replace(words[0], "x", 1) + " end" for t in texts[:10]]
    sets = [np.unique(trigrams(t)) for t in texts]
    ask = possible(sets, sets, 0.8)
    assert ask.mean() < 0.05 and ask[np.arange(10), np.arange(200, 210)].all()
    some = shared_elements(sets, sets, ask)
    monkeypatch.setattr(duplicates, "DENSE", -1.0)
    assert (some == shared_elements(sets, sets, ask)).all() and some[0, 200] == len(np.intersect1d(sets[0], sets[200]))


def test_clusters_are_numbered_as_they_are_met(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "RANGE_SAMPLE", 8)  # few bounds, the same numbers
    rows = [(f"r{i:03d}", f"c{(i * 7) % 40:02d}") for i in range(200)]
    random.Random(2).shuffle(rows)
    got = duplicates.cluster_numbers(spark.createDataFrame(rows, "id string, cluster string"), Workspace(spark, "n")).collect()
    order = list(dict.fromkeys(c for _, c in sorted(rows)))
    assert sorted(map(tuple, got)) == sorted((i, c, order.index(c)) for i, c in rows)
    assert duplicates.cluster_numbers(spark.createDataFrame([], "id string, cluster string"), Workspace(spark, "n")).count() == 0
