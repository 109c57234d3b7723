"""Byte-pair token counts of texts and of all spans between white space in them.

A text is split once into pieces (contractions, letters, digits, marks, white space); bytes are merged within
a piece only, lowest rank first, so a text's count is the sum over its pieces. Running sums over the pieces give the
count of any span that ends before white space as a difference: only where the span begins inside a piece (` The`
without its space) are pieces split again, until a piece ends where one of the text does. So chunks are planned by
bisection on these sums, although counts aren't additive at the borders of words.

A piece that is a token needs one lookup; merging takes O(n^2) for short pieces and O(n log n) for long ones. The table of counted
pieces that a worker keeps is bounded and only saves time. New pieces of a slice of texts are merged together, one merge of every piece
at a time on arrays of symbols, so a corpus of ever new words costs little more than one of few.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

from corpusq.functions.chunk import Layout
from corpusq.functions.text import BLANKS

_S = "[" + regex.escape(BLANKS) + "]"
_SA = "".join(f"\\x{ord(c):02x}" for c in BLANKS if c.isascii())
_NO = "[^" + regex.escape(BLANKS) + r"\p{L}\p{N}]"
#: Fixed pattern: the pieces of a text.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?{_NO}++|{_S}+(?![^{regex.escape(BLANKS)}])|{_S}+")
#: The same for texts of ASCII only, where it is faster.
PIECE_ASCII = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]++| ?[0-9]++| ?[^{_SA}A-Za-z0-9]++|[{_SA}]+(?![^{_SA}])|[{_SA}]+")
SHORT, KEEP_ENTRIES, KEEP_CHARS, AT_ONCE, SLICE = 64, 200_000, 32, 1 << 20, 1 << 19
NONE = 1 << 62  # in place of a rank


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token to rank from lines of a token in base 64, a space and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def pieces_of(text: str) -> list[str]:
    return (PIECE_ASCII if text.isascii() else PIECE).findall(text)


class Counted(dict):
    """Pieces and their tokens, counted when first asked for. When full, what wasn't asked for since the last time goes; long pieces aren't kept."""

    def __init__(self, merged: Callable[[bytes], int]) -> None:
        self.merged, self.old = merged, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece) or self.merged(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= KEEP_CHARS:
            self.room(1)
            self[piece] = n
        return n

    def room(self, n: int) -> None:
        if len(self) + n > KEEP_ENTRIES:
            self.old = dict(self)
            self.clear()


class Merges:
    """Merging of many pieces at once. A symbol is a rank, or a byte that is no token; a hash table has the pairs of symbols that form a token."""

    FREE = -1

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = list(ranks)
        number = {t: i for i, t in enumerate(sorted(tokens, key=ranks.__getitem__))}  # in the order of ranks, without gaps
        self.byte = np.array([number.setdefault(bytes([b]), len(number)) for b in range(256)], np.int64)
        found = [(a << 32 | b, number[t]) for t in tokens for i in range(1, len(t)) if (a := number.get(t[:i])) is not None and (b := number.get(t[i:])) is not None]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        self.bits = max(10, (2 * len(pairs)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, self.FREE), np.full(1 << self.bits, NONE)
        at = self._home(pairs[:, 0])
        while len(pairs):  # those whose place is taken go to the next one
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = pairs[free, 0]
            put = self.keys[at] == pairs[:, 0]
            self.made[at[put]] = pairs[put, 1]
            at, pairs = (at[~put] + 1) & (len(self.keys) - 1), pairs[~put]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def token(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair forms, or NONE."""
        keys = left << 32 | right
        at = self._home(keys)
        out, here = self.made[at], self.keys[at]
        late = np.flatnonzero((here != keys) & (here != self.FREE))
        out[here != keys] = NONE
        while len(late):
            at[late] = (at[late] + 1) & (len(self.keys) - 1)
            here = self.keys[at[late]]
            out[late[here == keys[late]]] = self.made[at[late[here == keys[late]]]]
            late = late[(here != keys[late]) & (here != self.FREE)]
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece (not empty): as `Ranks.merged`, the leftmost pair of the lowest rank first."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, own = size.copy(), np.arange(len(pieces))
        symbol = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        first = np.cumsum(size) - size
        # a pair's rank and the place of its left symbol, as one number: the least of a piece is merged next
        pair = np.full(len(symbol), NONE)
        inner = np.ones(len(symbol), bool)
        inner[first + size - 1] = False
        inner = np.flatnonzero(inner)
        pair[inner] = self.token(symbol[inner], symbol[inner + 1])
        while len(own):
            width = len(symbol)
            low = np.minimum.reduceat(np.where(pair < NONE, pair * width + np.arange(width), NONE), first)
            going = low < NONE
            out[own[~going]] = size[~going]
            stay = np.repeat(going, size)
            symbol, pair = symbol[stay], pair[stay]
            at = (low % width - np.cumsum(np.where(going, 0, size)))[going]
            own, size = own[going], size[going]
            symbol[at] = low[going] // width
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, pair = symbol[left], pair[left]
            at -= np.arange(len(at))  # one symbol fewer for every piece before
            size = size - 1
            first = np.cumsum(size) - size
            ends = first + size - 1
            pair[at] = NONE
            before, after = at[at > first] - 1, at[at < ends]
            pair[before] = self.token(symbol[before], symbol[before + 1])
            pair[after] = self.token(symbol[after], symbol[after + 1])
        return out


class Ranks:
    """A vocabulary by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.table = Counted(self.merged)
        self.piece = self.table.__getitem__
        self.merges = Merges(ranks)

    def merged(self, piece: bytes) -> int:
        """The number of tokens of a piece: neighbours of the lowest rank are merged, the leftmost first, until no two form a token."""
        if piece in self.ranks or len(piece) < 2:
            return len(piece[:1])
        return self._merged_short(piece) if len(piece) <= SHORT else self._merged_long(piece)

    def _merged_short(self, piece: bytes) -> int:
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        rank = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while rank and (low := min(rank)) < NONE:
            i = rank.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], NONE)
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], NONE)
        return len(parts)

    def _merged_long(self, piece: bytes) -> int:
        """With a heap of the possible merges (rank, start, middle, end), stale once one of its parts has changed."""
        n, get = len(piece), self.ranks.get
        end, before = [*range(1, n + 1), n + 1], [*range(-1, n)]
        alive = bytearray(b"\1") * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            middle = end[i]
            if middle < n and end[middle] - i <= self.longest and (r := get(piece[i : end[middle]])) is not None:
                heapq.heappush(heap, (r, i, middle, end[middle]))

        for i in range(n - 1):
            offer(i)
        count = n
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if not (alive[i] and end[i] == middle and alive[middle] and end[middle] == stop):
                continue
            end[i], alive[middle], count = stop, 0, count - 1
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return count

    def learn(self, found: list[list[str]]) -> None:
        """Put the new pieces of some texts into the table, also those without their space that may begin a sentence."""
        new = {p for p in set().union(*found).difference(self.table) if len(p) <= KEEP_CHARS}
        new |= {p[1:] for p in new if p[0] == " " and "A" <= p[1:2] <= "Z"}
        old, merge = self.table.old, []
        self.table.room(len(new))
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            if (n := old.get(p)) or raw in self.ranks or len(raw) < 2:
                self.table[p] = n or 1
            elif len(raw) <= SHORT:
                merge.append((p, raw))
        if merge:
            self.table.update(zip([p for p, _ in merge], self.merges.counts([raw for _, raw in merge]).tolist()))

    def count(self, text: str) -> int:
        if len(text) > AT_ONCE:
            return sum(self.piece(m[0]) for m in PIECE.finditer(text))
        return sum(map(self.piece, pieces_of(text)))


class PieceLayout(Layout):
    """A text's words and sentences as positions, and its pieces with running sums of their tokens."""

    def __init__(self, text: str, ranks: Ranks, found: list[str] | None = None) -> None:
        super().__init__(text)
        self.ranks = ranks
        found = pieces_of(text) if found is None else found
        self.borders = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        self.upto = np.concatenate(([0], np.cumsum(np.fromiter(map(ranks.piece, found), np.int64, len(found)))))

    def total(self) -> int:
        return int(self.upto[-1])

    def tokens(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of spans that end before white space or at the text's end."""
        first, last = np.searchsorted(self.borders, start), np.searchsorted(self.borders, end)
        out = self.upto[last] - self.upto[first]
        inside = np.flatnonzero(self.borders[first] != start)
        text, piece = self.text, self.ranks.piece
        for k, i, j in zip(inside.tolist(), start[inside].tolist(), self.borders[first[inside]].tolist()):
            if text[i - 1] == " " and text[i] != "'" and self.borders[first[k] - 1] == i - 1:  # without its space, the piece is still one
                out[k] += piece(text[i:j])
            else:
                out[k] = self._split_again(i, int(first[k]), int(last[k]))
        return out

    def _split_again(self, at: int, first: int, last: int) -> int:
        """From a place inside a piece to the first border that both splits have, then by the sums; `first` is the border after `at`."""
        n, stop = 0, int(self.borders[last])
        while at < stop:
            m = PIECE.match(self.text, at, stop)
            n, at = n + self.ranks.piece(m[0]), m.end()
            while self.borders[first] < at:
                first += 1
            if self.borders[first] == at:
                return n + int(self.upto[last] - self.upto[first])
        return n

    def packed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words with a space behind each: that space is a piece, and a token, by itself."""
        return self.tokens(start, end) + self.ranks.piece(" ")

    def joined(self, spans: list[tuple[int, int]]) -> int | None:
        """Of words with single spaces between them: what the text itself has there, if its spaces are single ones too."""
        if all(b == a + 1 and self.text[a] == " " for (_, a), (b, _) in zip(spans, spans[1:])):
            return int(self.tokens(np.array([spans[0][0]]), np.array([spans[-1][1]]))[0])
        return self.ranks.count(" ".join([self.text[i:j] for i, j in spans]))


class BytePairs:
    """A token counter for `Tokens` and the chunk functions; the ranks are broadcast (one vocabulary, of at most MOST bytes)."""

    MOST = 64 << 20
    _loaded: ClassVar[dict[int, Ranks]] = {}

    def __init__(self, shared: Broadcast) -> None:
        self.shared, self.key = shared, id(shared)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BytePairs:
        """From a rank file that Spark can read."""
        content = spark.read.format("binaryFile").load(path).select("content").first()[0]
        if len(content) > cls.MOST:
            raise ValueError(f"{path} is no vocabulary: it has {len(content)} bytes")
        return cls(spark.sparkContext.broadcast(parse_ranks(bytes(content))))

    def ranks(self) -> Ranks:
        if self.key not in self._loaded:
            self._loaded.clear()
            self._loaded[self.key] = Ranks(self.shared.value)
        return self._loaded[self.key]

    def __call__(self, text: str) -> int:
        return self.ranks().count(text)

    def layout(self, text: str) -> PieceLayout:
        return PieceLayout(text, self.ranks())

    def layouts(self, texts: Iterator[str]) -> Iterator[PieceLayout]:
        """Of one text after the other; the pieces of a slice of at least SLICE characters (or the rest) are held together, and learned together."""
        ranks, held, size = self.ranks(), [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= SLICE:
                yield from self._learned(ranks, held)
                held, size = [], 0
        yield from self._learned(ranks, held)

    @staticmethod
    def _learned(ranks: Ranks, texts: list[str]) -> Iterator[PieceLayout]:
        found = [pieces_of(t) for t in texts]
        ranks.learn(found)
        for k, t in enumerate(texts):
            yield PieceLayout(t, ranks, found[k])
