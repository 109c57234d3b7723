"""Content-defined chunks against a plain version."""

import hashlib
import random

import numpy as np
from llm_fixtures import sentence

from corpusq.llm import chunks
from corpusq.plans.workspace import Workspace


def plain_ends(text):
    out, last, h = [], None, 0
    for i, b in enumerate(text):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFF
        if (h >> (16 - chunks.BITS)) & (2**chunks.BITS - 1) == 0:
            if last is None or i + 1 - last >= chunks.QUIET:
                out.append(i + 1)
            last = i + 1
    if text and (not out or out[-1] != len(text)):
        out.append(len(text))
    return out


def plain(rows):
    first, out = {}, []
    parts = []
    for d, t in rows:
        b = (t or "").encode()
        ends = plain_ends(b)
        parts.append((d, b, ends, [b[s:e] for s, e in zip([0, *ends], ends)]))
        for c in parts[-1][3]:
            if d is not None:
                first[c] = min(first.get(c, d), d)
    for d, b, ends, own in parts:
        copies = [d is not None and first[c] < d for c in own]
        runs, i = [], 0
        while i < len(own):
            if copies[i]:
                j = i
                while j < len(own) and copies[j]:
                    j += 1
                if ends[j - 1] - (ends[i - 1] if i else 0) >= chunks.MIN_SPAN:
                    runs.append((i, j))
                i = j
            else:
                i += 1
        gone = {k for i, j in runs for k in range(i, j)}
        kept = b"".join(c for k, c in enumerate(own) if k not in gone)
        out.append((d, len(b), len(own), sum(copies), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), sorted({first[own[k]] for k in gone})))
    return out


def test_boundaries():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 40, 500, 5000):
        b = bytes(rng.choice(b"abc \n\xc3\xa9") for _ in range(n))
        assert chunks.boundaries(b).tolist() == plain_ends(b)
    assert len(chunks.boundaries(b"x" * 100_000)) < 20


def test_boundaries_come_back_after_an_insertion():
    rng = random.Random(2)
    b = sentence(rng, 2000).encode()
    moved = {e + 3 for e in chunks.boundaries(b).tolist() if e > 1100}
    assert moved <= set(chunks.boundaries(b[:1000] + b"xyz" + b[1000:]).tolist())


def test_equals_plain(spark, docs):
    rng = random.Random(3)
    passages = [sentence(rng, 60) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randrange(0, 60)) for _ in range(3)]
        parts += rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(300, rows[5][1]), (301, None), (302, ""), (None, rows[5][1]), rows[7], (303, "é" * 50_000), (304, "é" * 50_000)]
    got = [tuple(r) for r in chunks.dedup(docs(rows, extra=True), Workspace(spark, "cd")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    again = {r[0]: r for r in got}
    assert again[300][4] == again[300][1] and 5 in again[300][7]
    assert chunks.dedup(docs([]), Workspace(spark, "cd")).count() == 0


def test_long_passages_are_found():
    rng = random.Random(4)
    hits = 0
    for _ in range(300):
        p = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(52))
        one, two = (sentence(rng, 80) + " " + p + " " + sentence(rng, 80) for _ in range(2))
        known = {two.encode()[s:e] for s, e in zip([0, *chunks.boundaries(two.encode())], chunks.boundaries(two.encode()))}
        ends = chunks.boundaries(one.encode())
        copies = [i for i, (s, e) in enumerate(zip([0, *ends], ends)) if one.encode()[s:e] in known]
        hits += bool(chunks.spans(np.asarray(ends), copies))
    assert hits >= 285
