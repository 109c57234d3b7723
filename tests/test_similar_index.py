"""The index of similar texts against components by brute force."""

import random
import shutil

import pytest

from corpusq.operators.similar_index import SCHEMAS, SimilarIndex
from corpusq.plans import linkage

WORDS = [f"w{i:03d}" for i in range(400)]


def grams(t):
    t = t.lower()
    return {t[i : i + 3] for i in range(len(t) - 2)}


def alike(a, b, least=0.8):
    x, y = grams(a), grams(b)
    return a == b or (bool(x) and bool(y) and len(x & y) >= least * len(x | y))


def components(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, t) in enumerate(rows):
        for j, u in rows[:k]:
            if alike(t, u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i, _ in rows:
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g if len(g) > 1}


def made(seed, n=60):
    """Texts in drifting families, so that later ones join clusters of earlier ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 6):
        words = [rng.choice(WORDS) for _ in range(40)]
        for _ in range(6):
            texts.append(" ".join(words))
            words[rng.randrange(40)] = rng.choice(WORDS)
    texts += [texts[0], texts[7], "", "ab", "ab", "abc"]
    rows = [(f"r{k:03d}", t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "review_id string, text string")


@pytest.mark.parametrize("small", [False, True])
def test_batches_equal_brute_force(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(linkage, "ROWS", 3)
    rows = made(1 + small)
    path = f"file://{tmp_path}/index"
    index = SimilarIndex(spark, path)
    cuts = [0, 5, 40, 40, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        index.insert(table(spark, [*rows[a:b], (None, "no id"), ("nothing", None)]))
    got = {r.id: r.cluster for r in index.clusters().collect()}
    assert got == components(rows) and len(set(got.values())) > 5
    again = SimilarIndex(spark, path)  # opened anew, it goes on
    assert again.batches == 4
    again.insert(table(spark, rows[:10]))
    assert {r.id: r.cluster for r in again.clusters().collect()} == got


def test_queries_and_what_is_read(spark, tmp_path):
    rows = made(5, 36)
    held, asked = rows[:30], rows[30:]
    table(spark, held).write.parquet(f"{tmp_path}/texts")
    index = SimilarIndex(spark, f"file://{tmp_path}/index")
    index.insert(spark.read.parquet(f"{tmp_path}/texts"))
    shutil.rmtree(tmp_path / "texts")  # no later step reads an old text, and no table of the index has one
    assert not any("text" in s for s in SCHEMAS.values())
    group = {i: i for i, _ in held} | components(held)
    got = {r.id: (r.cluster, r.n_clusters) for r in index.query(table(spark, [*asked, ("new", "nothing like it at all 12345"), ("copy", held[3][1])])).collect()}
    for i, t in [*asked, ("new", "nothing like it at all 12345"), ("copy", held[3][1])]:
        near = {group[j] for j, u in held if alike(t, u)}
        assert got[i] == (min(near, default=None), len(near)), i
    index.insert(table(spark, asked))
    assert {r.id: r.cluster for r in index.clusters().collect()} == components(rows)


def test_a_failed_batch_is_written_anew(spark, tmp_path, monkeypatch):
    rows = made(9, 24)
    index = SimilarIndex(spark, f"file://{tmp_path}/index")
    index.insert(table(spark, rows[:12]))
    monkeypatch.setattr(SimilarIndex, "_commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.insert(table(spark, rows[12:20]))
    monkeypatch.undo()
    index = SimilarIndex(spark, f"file://{tmp_path}/index")
    assert index.batches == 1
    index.insert(table(spark, rows[12:]))
    assert {r.id: r.cluster for r in index.clusters().collect()} == components(rows)


def test_empty(spark, tmp_path):
    index = SimilarIndex(spark, f"file://{tmp_path}/index")
    assert index.query(table(spark, [("a", "some text here")])).collect() == [("a", None, 0)]
    index.insert(table(spark, []))
    assert index.clusters().collect() == []
