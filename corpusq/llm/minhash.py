"""MinHash near-duplicates: circulant MinHash, banding, exact Jaccard on full sets.

Signature (C-MinHash, Li and Li 2022): two permutations of the 32-bit universe. sigma scatters a
shingle once; coordinate k is the least pi(sigma(x) - k mod 2^32) over the set, so one permutation
pi, circularly shifted, gives all K coordinates. 32 bands of 4 coordinates find a pair of similarity
0.75 with probability 1 - (1 - 0.75^4)^32 > 0.99999.

Groups of copies never become pairs:

1. Documents with equal shingle sets form a class; its node is its smallest doc_id. Partial
   aggregation collapses a class before its shuffle.
2. The band buckets of two or more nodes go to `plans.linkage`, which confirms links on full sets:
   one star edge per node first, then the buckets whose nodes aren't in one component yet, compared by
   pairs of blocks inside tasks. A block is bounded in rows and in shingles, sets move instead of
   texts, and only links between components come out, one per node and component.
3. Components of the confirmed edges are found by large-star/small-star.

No bucket is capped, no row dropped, and pairs are never rows.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is kept;
ids are taken to be unique: rows that share a doc_id have one node if it is the smallest of their sets,
and each has a row in the result; a null doc_id is reached through its class, but names no component
unless its whole class has null ids (then component_id is null and kept false); an empty table gives
an empty result; other columns are ignored by `near_duplicates` and kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusq.llm.batches import pieces, text_bytes
from corpusq.llm.shingles import shingle_set
from corpusq.plans.linkage import similar_components
from corpusq.plans.once import free_name
from corpusq.plans.workspace import Workspace

BANDS, ROWS = 32, 4
COORDS = BANDS * ROWS
PERCENT = 75
UNNAMED = 1 << 62


def _mix(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS circulant minima (uint32) per non-empty set."""
    out = np.empty((len(sets), COORDS), np.uint32)
    at = 0
    while at < len(sets):  # groups of sets that fit a cache
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        scattered = _mix((x ^ (x >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64))).astype(np.int64)
        t, u = np.empty_like(scattered), np.empty_like(scattered)
        for k in range(COORDS):
            np.subtract(scattered, np.uint32(k + 1), out=t)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 0)):
                np.right_shift(t, np.uint32(shift), out=u)
                np.bitwise_xor(t, u, out=t)
                if factor:
                    np.multiply(t, np.uint32(factor), out=t)
            out[at:end, k] = np.minimum.reduceat(t, first)
        at = end
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is mixed in."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = (key ^ s[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, n_shingles, d1, d2 (digest of the set), bands."""
    for b in pieces(batches, 1):
        sets = [shingle_set(x) for x in text_bytes(b.column(1))]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, d1, d2 = ([None] * len(sets) for _ in range(3))
        if full:
            sig = signatures([sets[i] for i in full])
            for i, k in zip(full, band_keys(sig)):
                digest = xxhash.xxh3_128_digest(sets[i].tobytes())
                keys[i] = k
                d1[i], d2[i] = (int.from_bytes(digest[j : j + 8], "little", signed=True) for j in (0, 8))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "d1", "d2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, n, elements: the full set of shingles."""
    for b in pieces(batches, 1):
        sets = [shingle_set(x) for x in text_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "elements"])


def near_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = ws.save("profile", d.mapInArrow(_profile, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    some = profile.where("d1 is not null and doc_id is not null")
    classes = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = ws.save("classes", classes)

    texts = d.withColumnRenamed("doc_id", "node")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return texts.join(nodes, "node", "left_semi").mapInArrow(_sets, "node long, n long, elements binary")

    found = similar_components(ws, classes.select("node", F.explode("bands").alias("key")), sets_of, PERCENT)

    of_class = classes.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("reached"))
    out = profile.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("reached"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of docs, all their columns, without the near copies of a document with a smaller id.

    A row without an id takes one from its text, from UNNAMED on, so it stays unless it is a copy of a named
    document or of another such row. Of the rows with one id and one shingle set, one stays; blank rows without an id all stay.
    """
    own, digest = free_name(docs, "own_id"), free_name(docs, "set_digest")

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [xxhash.xxh3_128_digest(shingle_set(x).tobytes()) for x in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sets, pa.binary())], [*b.schema.names, digest])

    unnamed = F.lit(UNNAMED) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(UNNAMED - 1)
    d = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    found = near_duplicates(d.select(F.col(own).alias("doc_id"), "text"), ws).where("kept").groupBy(F.col("doc_id").alias(own))
    again = (F.count(F.lit(1)) > 1) & ((F.col(own) < UNNAMED) | (F.max("n_shingles") > 0))
    kept = ws.save("kept", found.agg(again.alias("again")))
    if kept.where("again").isEmpty():
        return d.join(kept, own, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    single = d.join(kept.where("not again"), own, "left_semi")
    several = d.join(kept.where("again"), own, "left_semi")
    one = several.mapInArrow(with_set, StructType([*several.schema.fields, StructField(digest, BinaryType())])).dropDuplicates([own, digest])
    return single.unionByName(one.drop(digest)).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Full sets, all pairs that share a shingle, and their components.
ORACLE = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near AS MATERIALIZED (SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * i >= {PERCENT} * (len(p.s) + len(q.s) - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS doc_id, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.doc_id WHERE r.root < e.b),
least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.root, s.doc_id)) AS component_id, coalesce(l.root, s.doc_id) >= s.doc_id AS kept
FROM sets s LEFT JOIN least l ON l.doc_id = s.doc_id
"""
