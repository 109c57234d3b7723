"""Exact substring dedup over suffix arrays of shards.

Every byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id is
removed. A suffix array of a whole corpus takes many times its size; only suffixes that can matter
are sorted, in shards that are independent of each other:

1. Anchors. In each window of LENGTH bytes the leftmost of the least hashes of its GRAM-byte strings
   is the window's anchor; equal windows have equal anchors at equal offsets. Windows of a document
   with the same anchor are adjacent, and the bytes they cover are the anchor's context (about one
   per 14 bytes). Contexts go by their anchor's hash to a part, as packed records of 33 bytes with a
   128-bit digest of the context; of equal contexts in one batch only those of the smallest document travel on.
2. Anchors of a single document are dropped. Of equal contexts all but those of the smallest document
   are copies as a whole. What is left are the distinct contexts of anchors that have several.
3. Those are a shard's text: its suffixes are sorted by external induced sorting with common-prefix
   values (`induced`), and neighbours that share LENGTH bytes are equal windows; all but those of the
   smallest document are copies. Equal windows always meet in one shard.
4. Copied windows are united per document, and its text is read once more.

The numbers of parts and shards follow from the bytes there are, PART_BYTES of text for a part and
SHARD_BYTES of contexts for a shard, so what a task holds doesn't grow with the input. A shard that is
larger all the same is sorted beyond memory.

Hot anchors. A string in a large share of all documents would gather their contexts in one part. So the
strings found often in a bounded sample are passed over as anchors as long as a window holds any other
one; a window of nothing else is the same in all its documents and collapses by its digest. Which
string is an anchor still follows from the window's bytes alone, so the sample never changes a result.

Contexts in step 2 are equal if 128-bit hashes agree; everything after that compares bytes.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows that share a
doc_id share decisions, and none is a source for the other; a row without doc_id is no source and
loses nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm import induced
from corpusq.llm.batches import slices, text_bytes
from corpusq.plans.workspace import Workspace

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
TABLE = np.random.default_rng(20240202).integers(0, 1 << 63, 256, np.uint64)
FACTOR = 0x9E3779B97F4A7C15
SEPARATOR = b"\xff"  # in no UTF-8 text
RECORD = np.dtype([("gram", "<u4"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "u1")])
PART_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
MAX_TASKS = 50_000
BATCH_BYTES = 6 << 20
SAMPLE_BYTES = 8 << 20
HOT_SHARE, HOT_LEAST = 0.002, 8  # of the sampled documents
HOT_BITS = 20


def gram_hashes(text: bytes) -> np.ndarray:
    """A hash of each GRAM-byte string of a text."""
    join = lambda a, b, width, size: a[: len(text) - size + 1] * np.uint64(pow(FACTOR, size - width, 1 << 64)) + b[width : len(text) - size + 1 + width]
    h = TABLE[np.frombuffer(text, np.uint8)]
    width, parts = 1, []
    while 2 * width <= GRAM:
        parts.append((width, h))
        h, width = join(h, h, width, 2 * width), 2 * width
    for more, part in reversed(parts):
        if width + more <= GRAM:
            h, width = join(h, part, width, width + more), width + more
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8)) & np.uint64((1 << HOT_BITS) - 1)


def anchors(text: bytes, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the anchor) of every context of a text.

    hot: a flag per slot of hashes; flagged strings are anchors only of windows without any other.
    """
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(text)
    key = h & np.uint64(0xFFFFFFFF00000000)
    if hot is not None:
        last = hot[_slot(h)]
        key >>= np.uint64(1)
        key &= np.uint64(0x7FFFFFFF00000000)
        key[last] |= np.uint64(1 << 63)
    key |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: n - LENGTH + 1], key[WINDOW - width :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    count = np.diff(np.append(start, len(at)))
    return start, count, h[at[start]] ^ (h[at[start]] >> np.uint64(29))


def hot_slots(docs: DataFrame, total_bytes: int) -> np.ndarray | None:
    """Flags of the strings in at least HOT_SHARE of the documents of a sample of about SAMPLE_BYTES; None without any.

    The sample goes through one task and its size is bounded; what comes back are slots, 2^HOT_BITS at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, n = [], 0, 0
        for b in batches:
            for x in text_bytes(b.column(0)):
                if len(x) >= LENGTH and size + len(x) <= 2 * SAMPLE_BYTES:
                    parts.append(np.unique(_slot(gram_hashes(x)).astype(np.uint32)))
                    size, n = size + len(x), n + 1
        held = np.bincount(np.concatenate(parts), minlength=1 << HOT_BITS) if parts else np.zeros(1 << HOT_BITS, int)
        # a slot is shared by a few strings: what chance gives each of them counts on top
        floor = max(HOT_LEAST, HOT_SHARE * n) + 4 * held.mean()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held >= floor), pa.int64())], ["slot"])

    sample = docs.select("text").sample(min(1.0, SAMPLE_BYTES / max(1, total_bytes)), seed=7) if total_bytes > SAMPLE_BYTES else docs.select("text")
    slots = sample.repartition(1).mapInArrow(count, "slot long").toArrow()["slot"].to_numpy()
    if not len(slots):
        return None
    hot = np.zeros(1 << HOT_BITS, bool)
    hot[slots] = True
    return hot


def _packed(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Windows as start and number in one integer."""
    return (start.astype(np.int64) << 8) | count.astype(np.int64)


def _not_first(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row's context (by its digest) is also in a smaller document.

    Should two digests share their lower half only, rows of one may be told apart: they are then compared later, as bytes.
    """
    order = np.argsort(low)
    a, b = low[order], high[order]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    least = np.empty(len(doc), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.append(head, len(doc))))
    return doc > least


def _anchor_stage(parts: int, hot: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text -> part, records: packed contexts of a part; or part, docs, windows: what is known to be copied."""

    def emit(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        start, count, gram, digest = [], [], [], []
        for x in texts:
            s, n, g = anchors(x, hot)
            digest.append(b"".join([xxhash.xxh3_128_digest(x[i:j]) for i, j in zip(s.tolist(), (s + n + (LENGTH - 1)).tolist())]))
            start.append(s.astype(np.uint32))
            count.append(n.astype(np.uint8))
            gram.append(g)
        if not any(digest):
            return
        f = {"at": np.concatenate(start), "n": np.concatenate(count), "gram": np.concatenate(gram), "doc": np.repeat(np.array(ids, np.int64), [len(x) for x in start])}
        both = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)
        del digest, start, count, gram
        f["low"], f["high"] = both[:, 0].copy(), both[:, 1].copy()
        del both
        copy = _not_first(f["low"], f["high"], f["doc"])
        part = ((f["gram"] >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        rest = np.flatnonzero(~copy)
        rest = rest[np.argsort(part[rest], kind="stable")]
        part = part[rest].astype(np.int32)
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        k, windows, docs = len(ends), _packed(f["at"][copy], f["n"][copy]), f["doc"][copy].astype("<i8").tobytes()
        columns = {name: f.pop(name)[rest].astype(RECORD[name]) for name in RECORD.names}
        blobs = [b"".join(columns[name][i:j].tobytes() for name in RECORD.names) for i, j in zip([0, *ends], ends)]
        del columns
        docs = pa.array([None] * k + [docs], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*part[ends - 1].tolist(), (ids[0] ^ ids[-1]) % parts], pa.int32()), pa.array([*blobs, None], pa.binary()), docs, pa.array([None] * k + [windows.astype("<i8").tobytes()], pa.binary())],
            ["part", "records", "docs", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                for i, x in zip(some.column(0).to_pylist(), text_bytes(some.column(1))):
                    ids.append(i)
                    texts.append(x)
                    size += len(x)
                    if size >= BATCH_BYTES:
                        yield from emit(ids, texts)
                        ids, texts, size = [], [], 0
        yield from emit(ids, texts)

    return run


def _fields(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Records, which are stored field by field, as a shuffle's compression likes them."""
    out: dict[str, list[np.ndarray]] = {name: [] for name in RECORD.names}
    for blob in blobs:
        k, at = len(blob) // RECORD.itemsize, 0
        for name in RECORD.names:
            kind = RECORD[name]
            out[name].append(np.frombuffer(blob, kind, k, at))
            at += k * kind.itemsize
    return {name: np.concatenate(x) for name, x in out.items()}


def _facts(doc: np.ndarray, window: np.ndarray, shard: np.ndarray | None = None) -> pa.RecordBatch:
    shard = np.full(len(doc), -1, np.int64) if shard is None else shard
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(window.astype(np.int64)), pa.array(shard.astype(np.int64))], ["doc_id", "window", "shard"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(part, its rows one by one) of batches sorted by their first column."""
    rows = ((r[0], r[1:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for part, group in groupby(rows, key=lambda r: r[0]):
        yield part, (r for _, r in group)


def _context_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed contexts of whole parts -> doc_id, window, shard: -1 for windows that are copies, else where their context is to be sorted."""
    for part, rows in _groups(batches):
        blobs = []
        for records, docs, windows in rows:
            if records is None:
                yield _facts(np.frombuffer(docs, "<i8"), np.frombuffer(windows, "<i8"))
            else:
                blobs.append(records)
        if not blobs:
            continue
        f = _fields(blobs)
        del blobs
        copy = _not_first(f.pop("low"), f.pop("high"), f["doc"])
        window = _packed(f.pop("at"), f.pop("n"))
        yield _facts(f["doc"][copy], window[copy])
        # of an anchor's other contexts those of one document can't be copies of each other
        rest = np.flatnonzero(~copy)
        rest = rest[np.argsort(f["gram"][rest])]
        gram, doc = f["gram"][rest], f["doc"][rest]
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        several = np.repeat(np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), np.diff(np.append(head, len(doc))))
        rest = rest[several]
        yield _facts(f["doc"][rest], window[rest], (np.int64(part) << 32) | f["gram"][rest].astype(np.int64))


def _text_stage(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, z, open, shard -> part, contexts: the bytes to sort, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        size = 0
        for b in batches:
            for doc, z, opened, shard in zip(*(c.to_pylist() for c in b.columns)):
                x = zstandard.decompress(z) if z else b""
                to = (np.array(shard, np.uint64) * np.uint64(FACTOR) >> np.uint64(32)) % np.uint64(shards)
                for w, g in zip(opened, to.tolist()):
                    at, n = w >> 8, w & 255
                    held.setdefault(g, []).append((doc, at, x[at : at + n + LENGTH - 1]))
                    size += n + LENGTH
                if size > 24 << 20:
                    yield _contexts(held)
                    held, size = {}, 0
        if held:
            yield _contexts(held)

    return run


def _contexts(held: dict[int, list[tuple[int, int, bytes]]]) -> pa.RecordBatch:
    blobs = []
    for rows in held.values():
        rows = [r for r in rows if len(r[2]) >= LENGTH]
        head = np.array([r[0] for r in rows], "<i8").tobytes() + np.array([r[1] for r in rows], "<u4").tobytes()
        blobs.append(np.array([len(rows)], "<i8").tobytes() + head + zstandard.compress(b"".join(r[2] + SEPARATOR for r in rows), 1))
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], ["part", "contexts"])


def copied_windows(blobs: Iterator[bytes], memory: int = induced.MEMORY) -> pa.RecordBatch | None:
    """The copied windows (as `_facts`) of one shard's contexts; its text and queues go to disk beyond `memory`."""
    docs, ats, starts, text = [], [], [], induced.Text(memory)
    for blob in blobs:
        k = int(np.frombuffer(blob, "<i8", 1)[0])
        if not k:
            continue
        piece = zstandard.decompress(blob[8 + 12 * k :])
        ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == SEPARATOR[0]) + 1
        docs.append(np.frombuffer(blob, "<i8", k, 8))
        ats.append(np.frombuffer(blob, "<u4", k, 8 + 8 * k))
        starts.append(np.concatenate(([0], ends[:-1])) + text.size)
        text.put(piece)
    if not text.size:
        return None
    x = text.bytes()
    doc, at, start = np.concatenate(docs), np.concatenate(ats).astype(np.int64), np.concatenate(starts)
    stop = np.append(start[1:], text.size) - 1
    found = []
    for number, pos in induced.equal_prefixes(x, text.size, memory):
        which = np.searchsorted(start, pos, "right") - 1
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        least = np.repeat(np.minimum.reduceat(doc[which], first), np.diff(np.append(first, len(number))))
        found.append(pos[(doc[which] > least) & (pos + LENGTH <= stop[which])])
    pos = np.sort(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
    if not len(pos):
        return None
    head = np.flatnonzero(np.concatenate(([True], np.diff(pos) != 1)))
    n = np.diff(np.append(head, len(pos)))
    which = np.searchsorted(start, pos[head], "right") - 1
    return _facts(doc[which], _packed(at[which] + pos[head] - start[which], n))


def _sort_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, contexts of whole shards -> doc_id, window, shard (-1)."""
    for _, rows in _groups(batches):
        if (out := copied_windows(r[0] for r in rows)) is not None:
            yield out


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, z: what moves is compressed text."""
    for b in batches:
        texts = text_bytes(b.column(1))
        for i, j in slices(b, [len(x) for x in texts]):
            z = zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([z.compress(x) for x in texts[i:j]], pa.binary())], ["doc_id", "z"])


def removed(length: int, copied: list[int] | None) -> list[tuple[int, int]]:
    """The maximal byte ranges that copied windows cover."""
    w = np.array(copied or [], np.int64)
    if not len(w):
        return []
    w.sort()
    start, end = w >> 8, np.minimum((w >> 8) + (w & 255) + LENGTH - 1, length)
    reach = np.maximum.accumulate(end)
    head = np.concatenate(([True], start[1:] > reach[:-1]))
    stop = reach[np.append(np.flatnonzero(head)[1:] - 1, len(reach) - 1)]
    return [(s, e) for s, e in zip(start[head].tolist(), stop.tolist()) if s < e]


def _cut_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, z, copied -> the results of documents."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64()] * 4 + [pa.string()]
    for b in batches:
        out = []
        for doc, z, copied in zip(*(c.to_pylist() for c in b.columns)):
            x = zstandard.decompress(z) if z else b""
            sha, at, gone = hashlib.sha256(), 0, removed(len(x), copied)
            for s, e in gone:
                sha.update(x[at:s])
                at = e
            sha.update(x[at:])
            out.append((doc, len(x), sum(e - s for s, e in gone), len(gone), sha.hexdigest()))
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def dedup(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = d.where("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    by_bytes = lambda n, size: max(-(-n // size), min(2 * cores, -(-n // (1 << 20))), 1)
    parts = by_bytes(total, PART_BYTES)
    packed = named.mapInArrow(_anchor_stage(parts, hot_slots(named, total)), "part int, records binary, docs binary, windows binary")
    packed = packed.repartitionById(min(parts, MAX_TASKS), F.col("part")).sortWithinPartitions("part")
    kind = "doc_id long, window long, shard long"
    facts = ws.save("facts", packed.mapInArrow(_context_stage, kind))

    zipped = d.mapInArrow(_zip, "doc_id long, z binary")
    open_ = facts.where("shard >= 0")
    shards = by_bytes(open_.agg(F.sum(F.col("window").bitwiseAND(255) + LENGTH)).first()[0] or 0, SHARD_BYTES)
    opened = open_.groupBy("doc_id").agg(F.collect_list("window").alias("open"), F.collect_list("shard").alias("shard"))
    contexts = zipped.join(opened, "doc_id").select("doc_id", "z", "open", "shard").mapInArrow(_text_stage(shards), "part int, contexts binary")
    resolved = contexts.repartitionById(min(shards, MAX_TASKS), F.col("part")).sortWithinPartitions("part").mapInArrow(_sort_stage, kind)
    resolved = ws.save("resolved", resolved)

    copied = facts.where("shard < 0").unionByName(resolved).groupBy("doc_id").agg(F.collect_list("window").alias("copied"))
    return zipped.join(copied, "doc_id", "left").select("doc_id", "z", "copied").mapInArrow(_cut_stage, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Every window of LENGTH bytes by its digest, texts as hexadecimal digits.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS w FROM d, unnest(range(0, n - {LENGTH - 1})) AS u(i) WHERE n >= {LENGTH}),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
copied AS (SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON f.w = x.w WHERE x.doc_id > f.first),
heads AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS head FROM copied),
numbered AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM heads),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM spans),
cut AS (SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""
