"""Induced sorting of the suffixes of a shard, with common-prefix values, by bucket queues on disk.

Suffixes are L-type (larger than the next suffix) or S-type; an S-type one after an L-type one is
sampled (LMS). From the sampled suffixes in order, a pass over the buckets upwards induces all L-type
suffixes and a pass downwards all S-type ones: taking a suffix from its bucket puts the suffix that
starts one byte before it at the end of its own bucket's queue. So each queue holds (position,
common-prefix value) tuples in final order, its key is the bucket's byte, and a suffix is written
once and read once, in sequence; that makes the 256 queues together a monotone priority queue. What
doesn't fit the memory budget goes to an unnamed file that ends with the queue.

Everything else is taken in blocks: types are found block by block from the text's end, sampled
positions wait in queues by their first byte, which are split by further bytes until SORT_ROWS of them
are ordered at a time, and the result comes out in blocks. The text is read by position and may be a
mapped file (`Text`). So a text far larger than memory needs the budget, SORT_ROWS suffixes and a few blocks.

The prefix two neighbours in a queue share is one byte plus the least common-prefix value between
the suffixes that induced them, found with a sparse table over the block being taken and a running
minimum per queue across blocks.

Only prefixes of DEPTH bytes matter here, which ends the recursion: a sampled suffix is ordered by its
first 56 bytes, as seven words. Suffixes that agree beyond are in any order, and values above are
lower bounds; both leave every comparison against DEPTH exact.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

DEPTH = 50
WORDS = 7
BLOCK = 1 << 20
TOP = 200  # values are clipped here
MEMORY = 64 << 20
SORT_ROWS = 1 << 20
SPILL = 1 << 16  # no queue writes less than this at a time
PAD = 64


class Text:
    """The bytes to sort, at most 2^31 of them, put piece by piece; in memory, or mapped from an unnamed file above the budget."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.parts, self.size, self.file = memory, [], 0, None

    def put(self, piece: bytes) -> None:
        self.size += len(piece)
        if self.file is None and self.size > self.memory:
            self.file = tempfile.TemporaryFile()
            for p in self.parts:
                self.file.write(p)
            self.parts = []
        if self.file is None:
            self.parts.append(piece)
        else:
            self.file.write(piece)

    def bytes(self) -> np.ndarray:
        """The text, with PAD zeros after it."""
        if self.file is None:
            return np.frombuffer(b"".join([*self.parts, b"\0" * PAD]), np.uint8)
        self.file.write(b"\0" * PAD)
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r", shape=(self.size + PAD,))


class Queue:
    """Positions with common-prefix values in order; oldest parts on disk once the budget is spent."""

    def __init__(self, budget: list[int]) -> None:
        self.budget, self.parts, self.held, self.file, self.count = budget, [], 0, None, 0
        self.small: list[tuple[np.ndarray, np.ndarray]] = []  # parts after those in `parts`, put together now and then

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.small.append((pos, lcp))
        if len(self.small) >= 64:
            self.gather()
        self.count += len(pos)
        self.held += 5 * len(pos)
        self.budget[0] -= 5 * len(pos)
        if self.budget[0] < 0 and self.held > SPILL:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
                self.sizes = []
            self.gather()
            pos, lcp = (np.concatenate(x) for x in zip(*self.parts))
            for i in range(0, len(pos), BLOCK):
                self.file.write(pos[i : i + BLOCK].tobytes())
                self.file.write(lcp[i : i + BLOCK].tobytes())
                self.sizes.append(len(pos[i : i + BLOCK]))
            self.budget[0] += self.held
            self.parts, self.held = [], 0

    def gather(self) -> None:
        if self.small:
            self.parts.append(self.small[0] if len(self.small) == 1 else tuple(np.concatenate(x) for x in zip(*self.small)))
            self.small = []

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All parts in order, with those put meanwhile; frees their memory."""
        if self.file is not None:
            self.file.seek(0)
            sizes, self.sizes = self.sizes, []
            stored = self.file
            self.file = None
            for n in sizes:
                yield np.frombuffer(stored.read(4 * n), np.int32), np.frombuffer(stored.read(n), np.uint8)
            stored.close()
        while self.parts or self.small or self.file is not None:
            if self.file is not None:  # spilled again meanwhile
                yield from self.take()
                continue
            self.gather()
            ready, self.parts = self.parts, []
            size, self.held = self.held, 0
            self.budget[0] += size
            pos, lcp = ready[0] if len(ready) == 1 else (np.concatenate(x) for x in zip(*ready))
            for i in range(0, len(pos), BLOCK):
                yield pos[i : i + BLOCK], lcp[i : i + BLOCK]

    def take_back(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All parts, the last first, each in reversed order; nothing is put meanwhile."""
        self.gather()
        parts, self.parts = self.parts, []
        self.budget[0] += self.held
        self.held = 0
        while parts:
            p, v = parts.pop()
            yield p[::-1], v[::-1]
        if self.file is not None:
            end = 5 * sum(self.sizes)
            for n in reversed(self.sizes):
                end -= 5 * n
                self.file.seek(end)
                p, v = np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(n), np.uint8)
                yield p[::-1], v[::-1]
            self.file.close()
            self.file = None


def sampled(x: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """LMS positions of the first n bytes, block by block from the end; the end is smaller than any byte."""
    later = False  # the type of the suffix after the block: whether it is S
    for high in range(n, 0, -BLOCK):
        low = max(0, high - BLOCK)
        step = np.sign(x[low + 1 : high + 1].astype(np.int16) - x[low:high])
        if high == n:
            step[-1] = -1
        at = np.arange(len(step))
        at[step == 0] = len(step)
        last = np.minimum.accumulate(at[::-1])[::-1]  # a run of one byte has the type of its last
        s = np.append(step > 0, later)[last]
        s = np.append(s, later)
        yield (np.flatnonzero(s[1:] & ~s[:-1]) + (low + 1)).astype(np.int32)
        later = bool(s[0])


def ordered(x: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their first 56 bytes, and the bytes each shares with the one before (at most 56)."""
    words = np.ndarray((len(x) - 7,), ">u8", x, strides=(1,))
    pos = pos.copy()
    group = np.zeros(len(pos), np.int32)
    lcp = np.zeros(len(pos), np.uint8)
    live = np.arange(len(pos))  # places in pos whose order isn't known yet; whole groups, contiguous
    for j in range(WORDS):
        if not len(live):
            break
        w = words[np.minimum(pos[live] + 8 * j, len(words) - 1)].astype(np.uint64)
        order = np.lexsort((w, group[live])) if j else np.argsort(w, kind="stable")
        pos[live], w, g = pos[live][order], w[order], group[live]
        same_group = g[1:] == g[:-1]
        differ = w[1:] != w[:-1]
        first = live[1:][same_group & differ]
        if len(first):
            d = (w[1:] ^ w[:-1])[same_group & differ]
            lead = np.zeros(len(d), np.uint8)
            for k in range(1, 8):
                lead += d < (np.uint64(1) << np.uint64(64 - 8 * k))
            lcp[first] = 8 * j + lead
        tied = same_group & ~differ
        lcp[live[1:][tied]] = 8 * j + 8
        new = np.concatenate(([0], np.cumsum(~tied)))
        many = np.zeros(len(live), bool)
        many[1:] |= tied
        many[:-1] |= tied
        group[live] = new
        live = live[many]
    return pos, lcp


def shared(x: np.ndarray, n: int, a: int, b: int) -> int:
    n = min(TOP, n - max(a, b))
    differ = np.flatnonzero(x[a : a + n] != x[b : b + n])
    return int(differ[0]) if len(differ) else n


def least_between(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(lcp[lo + 1 .. hi]) for each pair lo < hi."""
    span = hi - lo
    level = np.zeros(len(span), np.int64)
    top = int(span.max(initial=1)).bit_length() - 1
    for k in range(1, top + 1):
        level += span >= 1 << k
    out = np.empty(len(span), np.uint8)
    table = lcp
    for k in range(top + 1):
        if k:
            table = np.minimum(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at] + 1], table[hi[at] + 1 - (1 << k)])
    return out


class Pass:
    """One direction's queues and what is needed for common-prefix values across blocks."""

    def __init__(self, x: np.ndarray, upward: bool, budget: list[int]) -> None:
        self.x, self.upward = x, upward
        self.queues = [Queue(budget) for _ in range(256)]
        self.source = np.full(256, -2)  # the bucket that fed a queue last
        self.run = np.full(256, TOP, np.uint8)  # least value since

    def induce(self, c: int, pos: np.ndarray, lcp: np.ndarray, own_type: bool) -> None:
        """Take a block of bucket c (in this pass's order); lcp[0] is against the element before it."""
        before = np.where(pos > 0, self.x[np.maximum(pos, 1) - 1].astype(np.int16), -1)
        mine = (before > c) if self.upward else (before < c) & (before >= 0)
        if own_type:
            mine |= before == c
        rows = np.flatnonzero(mine & (before >= 0))
        if len(rows):
            dest = before[rows].astype(np.uint8)
            order = np.argsort(dest, kind="stable")
            rows, dest = rows[order], dest[order]
            starts = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1])))
            ends = np.concatenate((starts[1:], [len(rows)]))
            value = np.empty(len(rows), np.int64)
            inner = np.ones(len(rows), bool)
            inner[starts] = False
            inner = np.flatnonzero(inner)
            if len(inner):
                value[inner] = least_between(lcp, rows[inner - 1], rows[inner])
            upto = np.minimum.accumulate(lcp)
            left = np.minimum.accumulate(lcp[::-1])[::-1]  # min(lcp[i:])
            buckets = dest[starts]
            same = self.source[buckets] == c
            value[starts] = np.where(same, np.minimum(self.run[buckets], upto[rows[starts]]), 0)
            value = np.minimum(value + 1, TOP).astype(np.uint8)
            value[starts[self.source[buckets] == -2]] = 0
            pred = pos[rows] - 1
            last = rows[ends - 1]
            run = np.minimum(self.run, lcp.min(initial=TOP))
            run[buckets] = np.where(last + 1 < len(lcp), left[np.minimum(last + 1, len(lcp) - 1)], TOP)
            self.run = run
            self.source[buckets] = c
            for d, i, j in zip(buckets.tolist(), starts.tolist(), ends.tolist()):
                self.queues[d].put(pred[i:j], value[i:j])
        elif len(lcp):
            self.run = np.minimum(self.run, lcp.min())


def by_byte(x: np.ndarray, n: int, parts: Iterator[np.ndarray], depth: int, budget: list[int]) -> list[Queue]:
    """Positions in queues by the byte at `depth` of their suffixes."""
    out = [Queue(budget) for _ in range(256)]
    for pos in parts:
        byte = x[np.minimum(pos.astype(np.int64) + depth, n)]  # the byte after the text is 0
        order = np.argsort(byte, kind="stable")
        cuts = np.searchsorted(byte[order], np.arange(257))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            some = pos[order[cuts[c] : cuts[c + 1]]]
            out[c].put(some, np.zeros(len(some), np.uint8))
    return out


def ordered_parts(x: np.ndarray, n: int, queue: Queue, depth: int, budget: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions of a queue in order, in parts of at most SORT_ROWS (or BLOCK, if they agree in 56 bytes); all agree up to `depth`."""
    if not queue.count:
        return
    if depth >= 8 * WORDS:
        for pos, lcp in queue.take():
            yield pos, np.full(len(lcp), 8 * WORDS, np.uint8)
    elif queue.count <= SORT_ROWS:
        yield ordered(x, np.concatenate([p for p, _ in queue.take()]))
    else:
        for part in by_byte(x, n, (p for p, _ in queue.take()), depth, budget):
            yield from ordered_parts(x, n, part, depth + 1, budget)


def _blocks(pos: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(pos), BLOCK):
        yield pos[i : i + BLOCK], lcp[i : i + BLOCK]


def suffix_blocks(x: np.ndarray, n: int, memory: int = MEMORY) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(first of its bucket, positions, lcp) in blocks: greatest first byte first, suffixes in descending order.

    x: n bytes and PAD zeros. lcp[i] is what suffix i shares with the one before it; 0 at a bucket's first.
    """
    if not n:
        return
    budget = [memory]
    lms = by_byte(x, n, sampled(x, n), 0, budget)
    up = Pass(x, True, budget)
    kept: list[Queue] = []
    up.induce(-1, np.array([n], np.int32), np.zeros(1, np.uint8), False)
    for c in range(256):
        done, last = Queue(budget), None
        for pos, lcp in up.queues[c].take():
            done.put(pos, lcp)
            up.induce(c, pos, lcp, True)
            last = pos[-1]
        kept.append(done)
        for pos, lcp in ordered_parts(x, n, lms[c], 1, budget):
            lcp[0] = 0 if last is None else shared(x, n, int(last), int(pos[0]))
            for p, v in _blocks(pos, lcp):
                up.induce(c, p, v, False)
            last = pos[-1]
    del lms, up
    down = Pass(x, False, budget)
    for c in range(255, -1, -1):
        last = None
        for pos, lcp in down.queues[c].take():
            down.induce(c, pos, lcp, True)
            yield last is None, pos, lcp
            last = pos[-1]
        rise = None  # what the suffix taken last shares with the next smaller one, which follows here
        for pos, lcp in kept[c].take_back():
            head = rise if rise is not None else 0 if last is None else shared(x, n, int(last), int(pos[0]))
            rise = lcp[-1]
            lcp = np.concatenate((np.array([head], np.uint8), lcp[:-1]))
            down.induce(c, pos, lcp, False)
            yield last is None, pos, lcp
            last = pos[-1]


def suffix_buckets(x: np.ndarray, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`suffix_blocks` of a text in memory, put together by bucket."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for first, pos, lcp in suffix_blocks(np.append(x, np.zeros(PAD, np.uint8)), len(x), memory):
        if first and held:
            yield tuple(np.concatenate(p) for p in zip(*held))
            held = []
        held.append((pos, lcp))
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held))


def equal_prefixes(x: np.ndarray, n: int | None = None, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Positions of neighbouring suffixes with equal first DEPTH bytes: (class number, position), classes whole.

    x: n bytes and PAD zeros, or a whole text without n. What is held across blocks is the class that goes on.
    """
    if n is None:
        x, n = np.append(x, np.zeros(PAD, np.uint8)), len(x)
    pos, again, number = np.zeros(0, np.int32), np.zeros(0, bool), 0

    def classes(pos: np.ndarray, again: np.ndarray) -> Iterator[np.ndarray]:
        nonlocal number
        member = again.copy()
        member[:-1] |= again[1:]
        if member.any():
            of = np.cumsum(~again) + number
            yield np.stack((of[member], pos[member]))
            number = int(of[-1])

    for first, p, lcp in suffix_blocks(x, n, memory):
        a = lcp >= DEPTH
        if first:
            a[0] = False
        if len(pos) and not a[0]:
            yield from classes(pos, again)
            pos, again = pos[:0], again[:0]
        pos, again = np.concatenate((pos, p)), np.concatenate((again, a))
        start = len(again) - 1 - int(np.argmin(again[::-1]))  # of the class that may go on
        if start:
            yield from classes(pos[:start], again[:start])
            pos, again = pos[start:], again[start:]
    yield from classes(pos, again)
