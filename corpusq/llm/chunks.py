"""Substring dedup by content-defined chunks.

A gear rolling hash over the last WINDOW bytes marks a boundary where BITS of its bits are zero, so
boundaries depend on nearby content only and come back after an insertion or deletion. (A boundary
within QUIET bytes after another mark is passed over, which keeps runs of one byte in one chunk.) A
chunk is named by a digest of 96 bits. A chunk that also occurs in a document with a smaller
doc_id is a copy; a run of adjacent copies of MIN_SPAN bytes or more is removed, so that a short
common phrase alone removes nothing.

Shape of the plan: one row per chunk, an aggregation by digest combined before its shuffle, a join of
the digests that occur in several documents (which AQE splits at a hot passage), a list of copies per
document, and the texts of documents with copies move once.

Defined results: texts are UTF-8 bytes, a null one is empty; in-document repeats are no copies; rows
that share a doc_id count as one document; a row without doc_id has copies of none and removes
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.batches import text_bytes
from corpusq.plans.once import spread
from corpusq.plans.workspace import Workspace

WINDOW = 16
BITS = 5
QUIET = 8
MIN_SPAN = 64
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, np.uint32)


def boundaries(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text; the last is its length."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    h = GEAR[np.frombuffer(text, np.uint8)]
    width = 1
    while width < WINDOW:  # sum of GEAR[b[i - j]] << j for j < width, doubled each time
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero((h >> np.uint32(WINDOW - BITS)) & np.uint32((1 << BITS) - 1) == 0) + 1
    if len(marks):
        marks = marks[np.concatenate(([True], np.diff(marks) >= QUIET))]
    return marks if len(marks) and marks[-1] == n else np.append(marks, n)


def spans(ends: np.ndarray, copies: list[int], min_span: int = MIN_SPAN) -> list[tuple[int, int]]:
    """Runs of adjacent copied chunks that are long enough, as byte ranges."""
    out: list[list[int]] = []
    for i in sorted(set(copies)):
        start = int(ends[i - 1]) if i else 0
        if out and out[-1][1] == start:
            out[-1][1] = int(ends[i])
        else:
            out.append([start, int(ends[i])])
    return [(a, b) for a, b in out if b - a >= min_span]


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, i, digest, more (64 and 32 bits of a digest) of every chunk."""
    for b in batches:
        doc, at, digest = [], [], []
        for d, x in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            start, ends = 0, boundaries(x).tolist()
            for e in ends:
                digest.append(xxhash.xxh3_128_digest(x[start:e]))
                start = e
            doc += [d] * len(ends)
            at += range(len(ends))
            if len(doc) > 200_000:
                yield _rows(doc, at, digest)
                doc, at, digest = [], [], []
        yield _rows(doc, at, digest)


def _rows(doc: list, at: list, digest: list[bytes]) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
    more = both[:, 1].astype(np.int32)  # its lower half
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(both[:, 0].copy()), pa.array(more)], ["doc_id", "i", "digest", "more"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, copies, sources -> the results of documents."""
    names = ["doc_id", "n_bytes", "n_chunks", "n_copies", "n_removed", "n_spans", "kept_sha256", "copied_from"]
    types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64())]
    for b in batches:
        out = []
        for d, x, copies, sources in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
            ends = boundaries(x)
            own = [(i, s) for i, s in zip(copies or [], sources or []) if i < len(ends)]
            gone = spans(ends, [i for i, _ in own])
            sha, at = hashlib.sha256(), 0
            for start, stop in gone:
                sha.update(x[at:start])
                at = stop
            sha.update(x[at:])
            starts = np.array([s for s, _ in gone], np.int64)
            stops = np.array([e for _, e in gone], np.int64)
            from_docs = set()
            for i, s in own:
                k = int(np.searchsorted(starts, ends[i] - 1, "right")) - 1
                if k >= 0 and ends[i] <= stops[k]:
                    from_docs.add(s)
            out.append((d, len(x), len(ends), len({i for i, _ in own}), int((stops - starts).sum()), len(gone), sha.hexdigest(), sorted(from_docs)))
        columns = list(zip(*out)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def dedup(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_copies, n_removed, n_spans, kept_sha256, copied_from for every row of docs.

    copied_from: the smallest doc_ids that hold the removed chunks.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = d.where("doc_id is not null").mapInArrow(_chunk, "doc_id long, i int, digest long, more int")
    chunks = ws.save("chunks", chunks)
    first = chunks.groupBy("digest", "more").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    copies = chunks.join(spread(first), ["digest", "more"]).where("doc_id > source")
    copies = copies.groupBy("doc_id").agg(F.collect_list("i").alias("copies"), F.collect_list("source").alias("sources"))
    out = d.join(copies, "doc_id", "left").select("doc_id", "text", "copies", "sources")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_chunks long, n_copies long, n_removed long, n_spans long, kept_sha256 string, copied_from array<long>")


_LAGS = " + ".join(f"(coalesce(lag(v, {j}) OVER w, 0) << {j})" if j else "v" for j in range(WINDOW))
#: The same by whole chunks instead of digests, texts as hexadecimal digits; only the low WINDOW bits of the rolling hash matter.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
digits AS (SELECT '0123456789ABCDEF' AS x, {[int(g) & 0xFFFF for g in GEAR]} AS gear),
bytes AS MATERIALIZED (SELECT doc_id, i, gear[16 * (strpos(x, substr(h, 2 * i + 1, 1)) - 1) + strpos(x, substr(h, 2 * i + 2, 1))]::BIGINT AS v FROM d, digits, unnest(range(0, n)) AS u(i)),
rolled AS (SELECT doc_id, i, {_LAGS} AS s FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marks AS (SELECT doc_id, i + 1 AS e FROM rolled WHERE (s >> {WINDOW - BITS}) & {(1 << BITS) - 1} = 0),
spaced AS (SELECT doc_id, e FROM (SELECT *, e - lag(e) OVER (PARTITION BY doc_id ORDER BY e) AS gap FROM marks) WHERE gap IS NULL OR gap >= {QUIET}),
ends AS (SELECT doc_id, e FROM spaced UNION SELECT doc_id, n FROM d WHERE n > 0),
parts AS (SELECT doc_id, e, lag(e, 1, 0) OVER w AS b, row_number() OVER w AS i FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY e)),
chunks AS MATERIALIZED (SELECT p.doc_id, p.i, p.b, p.e, substr(d.h, 2 * p.b + 1, 2 * (p.e - p.b)) AS c FROM parts p JOIN d ON d.doc_id = p.doc_id),
firsts AS (SELECT c, min(doc_id) AS source FROM chunks GROUP BY c HAVING min(doc_id) < max(doc_id)),
copies AS MATERIALIZED (SELECT k.doc_id, k.i, k.b, k.e, f.source, k.i - row_number() OVER (PARTITION BY k.doc_id ORDER BY k.i) AS run FROM chunks k JOIN firsts f ON f.c = k.c WHERE k.doc_id > f.source),
runs AS (SELECT doc_id, run, min(b) AS a, max(e) AS z, list(source) AS sources FROM copies GROUP BY doc_id, run HAVING max(e) - min(b) >= {MIN_SPAN}),
gaps AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM runs),
cut AS (SELECT x.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, list_sort(list_distinct(flatten(list(sources)))) AS copied_from, string_agg(substr(h, 2 * g + 1, 2 * (a - g)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM gaps x JOIN d ON d.doc_id = x.doc_id GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_copies FROM copies GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n.n_chunks, 0) AS n_chunks, coalesce(m.n_copies, 0) AS n_copies, CAST(coalesce(cut.n_removed, 0) AS BIGINT) AS n_removed, coalesce(cut.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(cut.kept, d.h))) AS kept_sha256, coalesce(cut.copied_from, []) AS copied_from
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id
"""
