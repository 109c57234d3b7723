"""Near-duplicates against brute force over full sets."""

import random
import re

import numpy as np
import pyarrow as pa

from corpusq.llm import minhash
from corpusq.llm.shingles import shingle_set
from corpusq.plans.workspace import Workspace
from llm_fixtures import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0]
            both = len(sets[i] & sets[j])
            if (both and 100 * both >= 75 * len(sets[i] | sets[j])) or same:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp[root(i)] = min(comp.get(root(i), d), d)
    return sorted((d, len(sets[i]), comp[root(i)], comp[root(i)] == d) for i, (d, _) in enumerate(rows))


def edits(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_shingle_sets_equal_plain():
    rng = random.Random(5)
    for n in (0, 1, 3, 4, 5, 6, 30, 300):
        text = " ".join(rng.choice(["a", "B", "É", "é", "c"]) for _ in range(n))
        assert len(shingle_set(text.encode())) == len(plain_set(text))
    assert np.array_equal(shingle_set(b"A b\tC"), shingle_set(b"a  B c"))
    assert not np.array_equal(shingle_set("É x".encode()), shingle_set("é x".encode()))


def test_groups(spark, docs):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = sentence(rng, 120)
        rows += [edits(rng, base, rng.choice([0, 0, 1, 2, 3, 4, 5])) for _ in range(rng.choice([1, 2, 5, 40]))]
    shared = sentence(rng, 60)
    rows += [shared + " " + sentence(rng, rng.choice([20, 40])) for _ in range(700)]
    rows += [None, "", " \n", "a b", "A b", "a b c", "a b c d e", "x y z w v u"]
    rng.shuffle(rows)
    pairs = list(enumerate(rows))
    pairs.append(pairs[10])
    got = minhash.near_duplicates(docs(pairs, extra=True), Workspace(spark, "mh")).collect()
    assert sorted(map(tuple, got)) == brute(pairs)


def test_long_chain_and_long_text(spark, docs):
    rng = random.Random(8)
    words = sentence(rng, 200).split()
    rows = []
    for _ in range(30):
        rows.append(" ".join(words))
        for _ in range(2):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
    long = sentence(rng, 60_000)
    rows += [long, edits(rng, long, 500), "z " * 300_000]
    got = minhash.near_duplicates(docs(rows), Workspace(spark, "mh")).collect()
    assert sorted(map(tuple, got)) == brute(list(enumerate(rows)))


def test_empty_and_null_ids(spark, docs):
    assert minhash.near_duplicates(docs([]), Workspace(spark, "mh")).count() == 0
    got = {r.doc_id: r for r in minhash.near_duplicates(docs([(None, "a b c"), (4, "a b c"), (3, "a B c")]), Workspace(spark, "mh")).collect()}
    assert got[None].component_id == 3 and not got[None].kept and got[3].kept and not got[4].kept


def test_keep_first_keeps_columns(spark, docs):
    d = docs(["a b c d e f", "a b c d e f", None, "other words here"], extra=True)
    kept = minhash.keep_first(d, Workspace(spark, "mh"))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_keep_first_without_ids_and_with_repeated_rows(spark, docs):
    same = "a b c d e f"
    d = docs([(None, "a text of its own"), (None, "one more text"), (None, "one more text"), (None, same), (None, ""), (None, None), (3, same), (3, same), (4, same), (5, "other words here"), (5, "other words here"), (5, "quite another text")], extra=True)
    kept = minhash.keep_first(d, Workspace(spark, "mh"))
    assert kept.columns == d.columns
    want = [(None, "a text of its own"), (None, "one more text"), (None, ""), (None, None), (3, same), (5, "other words here"), (5, "quite another text")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    clash = d.selectExpr("*", "1 AS again", "2 AS own_id", "3 AS set_digest", "4 AS _id")
    assert sorted(((r.doc_id, r.text) for r in minhash.keep_first(clash, Workspace(spark, "mh")).collect()), key=str) == sorted(want, key=str)
    alone = minhash.keep_first(docs([(None, "a text of its own"), (1, same)]), Workspace(spark, "mh"))
    assert alone.count() == 2


def test_many_five_word_texts_in_one_bucket(spark, monkeypatch):
    """50,000 texts of one shingle each, all in the same bucket: memory is bounded by blocks, not by the bucket."""
    n = 50_000
    whole = minhash._profile

    def same_bucket(batches):
        for b in whole(batches):
            bands = pa.array([[1, 2]] * b.num_rows, pa.list_(pa.int64()))
            yield b.set_column(4, "bands", bands)

    monkeypatch.setattr(minhash, "_profile", same_bucket)
    frame = spark.range(n).selectExpr("id AS doc_id", "concat('a b c d w', id div 2, ' ') AS text", "'en' AS lang")
    got = minhash.near_duplicates(frame, Workspace(spark, "mh"))
    assert got.where("component_id <> doc_id - doc_id % 2 or n_shingles <> 1").isEmpty() and got.count() == n
