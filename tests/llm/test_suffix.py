"""Exact substring dedup against a plain version."""

import hashlib
import random

import numpy as np
from llm_fixtures import sentence

from corpusq.llm import suffix
from corpusq.plans.workspace import Workspace


def plain(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                w = b[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_windows_have_one_anchor():
    rng = random.Random(1)
    for n in (0, 49, 50, 51, 100, 3000):
        b = bytes(rng.choice(b"ab c") for _ in range(n))
        start, count, gram = suffix.anchors(b)
        assert count.sum() == max(0, n - 49) and (not len(count) or count.max() <= suffix.WINDOW)
        assert np.array_equal(np.cumsum(count)[:-1], start[1:]) and len(gram) == len(start)
    s, n, g = suffix.anchors(b"x" * 1000 + b[:200])
    s2, n2, g2 = suffix.anchors(b"yy" + b"x" * 1000 + b[:200])
    assert set(g) <= set(g2)


def test_equals_plain(spark, docs):
    rng = random.Random(6)
    passages = [sentence(rng, rng.randrange(4, 40)) for _ in range(6)]
    base = sentence(rng, 80)
    rows = []
    for i in range(140):
        parts = [sentence(rng, rng.randrange(0, 40)) for _ in range(2)] + rng.choices(passages, k=rng.randrange(3))
        rng.shuffle(parts)
        text = rng.choice(["", "é"]) + " ".join(parts)
        if i % 4 == 0:
            words = base.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["ß", "x", "changed"])
            text = " ".join(words)
        rows.append((i, text))
    rows += [(300, rows[5][1]), (301, None), (302, ""), (None, rows[5][1]), rows[7], (303, "é" * 700), (304, "é" * 900), (305, "ab" * 500), (306, "ab" * 25), (307, "ab" * 24 + "a"), (308, "x" * 49), (309, "x" * 49)]
    rng.shuffle(rows)
    got = [tuple(r) for r in suffix.dedup(docs(rows, extra=True), Workspace(spark, "sa")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    assert sum(r[2] for r in got) > 5000


def test_long_and_empty(spark, docs):
    rng = random.Random(7)
    long = sentence(rng, 20_000)
    got = {r.doc_id: r for r in suffix.dedup(docs([(1, long), (2, "z" + long[5:]), (3, long[100:300]), (4, "q" * 300_000)]), Workspace(spark, "sa")).collect()}
    assert got[1].n_removed == got[4].n_removed == 0 and got[2].n_removed == got[2].n_bytes - 1 and got[3].n_removed == 200
    assert suffix.dedup(docs([]), Workspace(spark, "sa")).count() == 0


def test_many_parts_shards_and_hot_strings(spark, docs, monkeypatch):
    for name, value in (("PART_BYTES", 2000), ("SHARD_BYTES", 1500), ("SAMPLE_BYTES", 20_000), ("HOT_LEAST", 3)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(16)
    line = "this very common line stands in a third of all documents, whatever they are about"
    rows = []
    for i in range(200):
        parts = [sentence(rng, rng.randrange(0, 12)) for _ in range(2)]
        if i % 3 == 0:
            parts.insert(1, line if i % 2 else line[rng.randrange(20) :])
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, "")]
    frame = docs(rows)
    hot = suffix.hot_slots(frame, 10**9)
    assert hot is None or hot.sum() < 5000
    assert suffix.hot_slots(frame, 1).sum() >= len(line) - 40
    got = [tuple(r) for r in suffix.dedup(frame, Workspace(spark, "sa")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_hot_strings_are_passed_over():
    hot = np.zeros(1 << suffix.HOT_BITS, bool)
    common = b"a line that is in very many documents"
    hot[suffix._slot(suffix.gram_hashes(common))] = True
    rng = random.Random(2)
    mine = bytes(rng.randrange(97, 122) for _ in range(60))
    start, count, gram = suffix.anchors(mine + common + mine[::-1], hot)
    assert count.sum() == 2 * len(mine) + len(common) - 49 and not hot[suffix._slot(suffix.gram_hashes(mine))].any()
    flagged = set((suffix.gram_hashes(common) ^ (suffix.gram_hashes(common) >> np.uint64(29))).tolist())
    assert not flagged & set(gram.tolist())
    every = suffix.gram_hashes(common * 3)
    alone = set(suffix.anchors(common * 3, np.ones(1 << suffix.HOT_BITS, bool))[2].tolist())
    assert alone and alone <= set((every ^ (every >> np.uint64(29))).tolist())


def test_shard_beyond_memory(monkeypatch):
    monkeypatch.setattr(suffix.induced, "BLOCK", 500)
    monkeypatch.setattr(suffix.induced, "SORT_ROWS", 300)
    rng = random.Random(4)
    base = bytes(rng.choice(b"abcdef ") for _ in range(900))
    held = {0: [(rng.randrange(40), i, base[j : j + rng.randrange(50, 90)]) for i in range(400) for j in [rng.randrange(700)]]}
    (blob,) = suffix._contexts(held).column(1).to_pylist()
    key = lambda b: sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert key(suffix.copied_windows(iter([blob]), 0)) == key(suffix.copied_windows(iter([blob]))) != []
