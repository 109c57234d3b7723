"""Induced sorting against sorted()."""

import random
import tracemalloc

import numpy as np
import pytest

from corpusq.llm import induced


def texts():
    rng = random.Random(3)
    yield b"mississippi\xff"
    yield b"a"
    yield b"aaaaaaaaaaaaaaaa" * 20
    yield bytes(rng.choice(b"ab") for _ in range(3000))
    yield bytes(rng.randrange(256) for _ in range(3000))
    base = bytes(rng.choice(b"abcd ") for _ in range(400))
    yield b"\xff".join(base[rng.randrange(200) :][: rng.randrange(200)] for _ in range(60)) + b"\xff"
    yield (b"abcabcabd" * 40 + b"\xff") * 8
    yield b"zyxw" * 100 + b"\x00" * 70 + b"wxyz" * 100


@pytest.mark.parametrize("memory", [1 << 20, 0])
def test_order_and_common_prefixes(memory, monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", 97)
    for t in texts():
        x = np.frombuffer(t, np.uint8)
        seen = []
        for pos, lcp in induced.suffix_buckets(x, memory):
            cut = [t[p : p + induced.DEPTH] for p in pos.tolist()]
            assert cut == sorted(cut, reverse=True)
            for i in range(1, len(pos)):
                a, b = t[pos[i - 1] :], t[pos[i] :]
                n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert min(int(lcp[i]), induced.DEPTH) == min(n, induced.DEPTH), (t, i)
            seen += pos.tolist()
        assert sorted(seen) == list(range(len(t)))


def test_equal_prefixes():
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(300))
    t = b"".join(base[i : i + 120] + b"\xff" for i in (0, 30, 100, 150, 30))
    got = {}
    for classes in induced.equal_prefixes(np.frombuffer(t, np.uint8)):
        for c, p in classes.T.tolist():
            got.setdefault((t[p], c), []).append(p)
    want = {}
    for p in range(len(t) - 49):
        want.setdefault(t[p : p + 50], []).append(p)
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert sorted(sorted(v) for v in got.values()) == want


@pytest.mark.parametrize("rows", [1, 7, 10**6])
def test_sampled_suffixes_are_ordered_in_parts(rows, monkeypatch):
    monkeypatch.setattr(induced, "SORT_ROWS", rows)
    test_order_and_common_prefixes(0, monkeypatch)
    test_equal_prefixes()


def test_a_text_beyond_memory(monkeypatch):
    """4 MB of text with a budget of 64 KB: what is allocated, mostly the tails of 256 queues, stays below the text's own size."""
    for name in ("BLOCK", "SORT_ROWS", "SPILL"):
        monkeypatch.setattr(induced, name, 1 << 13)
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    pieces = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 30))) for _ in range(4000)]
    order = [rng.randrange(len(pieces)) if rng.random() < 0.1 else i % len(pieces) for i in range(38_000)]
    budget, size = 1 << 16, 0
    tracemalloc.start()
    text = induced.Text(budget)
    for i in order:
        piece = (pieces[i] if size % 5 else f"{size} {pieces[i][:60]}").encode() + b"\xff"
        text.put(piece)
        size += 1
    x = text.bytes()
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    members = sum(c.shape[1] for c in induced.equal_prefixes(x, text.size, budget))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert isinstance(x, np.memmap) and text.size > 4_000_000 and members > text.size // 2
    assert peak < text.size, peak
