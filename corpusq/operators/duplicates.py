"""Exact and near duplicates by text and by character trigrams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.plans import linkage
from corpusq.plans.components import connected_components
from corpusq.plans.linkage import intersections, similar_components
from corpusq.plans.once import free_name, spread
from corpusq.plans.workspace import Workspace

BANDS, ROWS = 9, 13  # of 128 hash functions, for a threshold of 0.8
VERIFIED_BANDS, VERIFIED_ROWS = 32, 8
THRESHOLD = 0.8
RANGE_SAMPLE = 4096
PARITY = 1024  # classes of hashed elements
KEYED = 256
SKETCHES = 8192  # rows of a large block
MATRIX = 1 << 22
DEALT = 8  # sketches of a set that are dealt out at once
DENSE = 0.05  # share of pairs from which a block's intersections are counted all at once


def parameters(threshold: float, hashes: int, false_positive: float = 0.5, false_negative: float = 0.5) -> tuple[int, int]:
    """(bands, rows) of at most `hashes` functions with the least weighted error for a threshold.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands; its area below the threshold is the
    false positives', what it misses above the threshold the false negatives'. Areas are integrated by Gauss's rule.
    """
    if not 0 < threshold < 1 or hashes < 1:
        raise ValueError("the threshold must lie between 0 and 1, and there must be a hash function")
    node, factor = np.polynomial.legendre.leggauss(96)
    low, high = threshold * (node + 1) / 2, threshold + (1 - threshold) * (node + 1) / 2
    best = None
    for bands in range(1, hashes + 1):
        rows = np.arange(1, hashes // bands + 1)[:, None]
        found = (1 - (1 - low**rows) ** bands) @ factor * threshold / 2
        missed = ((1 - high**rows) ** bands) @ factor * (1 - threshold) / 2
        error = false_positive * found + false_negative * missed
        i = int(np.argmin(error))
        if best is None or error[i] < best[0]:
            best = float(error[i]), bands, i + 1
    return best[1], best[2]


def _cluster_number(flag: Column, of: Column) -> Column:
    """A non-negative number of the cluster named `of`, -1 for rows in none."""
    return F.when(flag, F.xxhash64(of).bitwiseAND((1 << 62) - 1)).otherwise(F.lit(-1).cast("long"))


def keep_first(df: DataFrame, key: str = "review_id", texts: DataFrame | None = None) -> DataFrame:
    """is_duplicate for all but the first row (by key) of equal texts; duplicate_cluster_id is -1 for the first.

    Rows that share key and text are one document: all of them have its flag. A row with a null text is no
    duplicate; a null key comes after all others. A hot text is combined before its shuffle, and only texts
    that occur again are joined back, where a row compares itself with its text's first. texts: see `members`.
    """
    t, first, n = (free_name(df, x) for x in ("text_digest", "first_key", "rows_of_text"))
    firsts = (df if texts is None else texts).groupBy(F.sha2("text", 256).alias(t)).agg(F.min(key).alias(first), F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    out = df.withColumn(t, F.sha2("text", 256)).join(spread(firsts), t, "left")
    again = F.col(n).isNotNull() & ~F.col(key).eqNullSafe(F.col(first))
    return out.withColumns({"is_duplicate": again, "duplicate_cluster_id": _cluster_number(again, F.col(t))}).drop(t, first, n)


def members(df: DataFrame, key: str = "review_id", texts: DataFrame | None = None) -> DataFrame:
    """is_duplicate for every row whose text occurs again; the cluster is named by its text. A null text is no duplicate.

    texts: a table to count in instead of df, if that is costly: each text of df with just df's rows of it, and any other texts.
    """
    t, n = free_name(df, "text_digest"), free_name(df, "rows_of_text")
    counts = (df if texts is None else texts).groupBy(F.sha2("text", 256).alias(t)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    out = df.withColumn(t, F.sha2("text", 256)).join(spread(counts), t, "left")
    again = F.col(n).isNotNull()
    return out.withColumns({"is_duplicate": again, "duplicate_cluster_id": _cluster_number(again, F.col(t))}).drop(t, n)


def ordinals(groups: DataFrame, ws: Workspace) -> DataFrame:
    """t, group_no for groups (t, first; a row each): dense numbers from 0 in the order of first.

    What is ordered is a row per group, and that by ranges: a group's number is its place within its range after the groups of all
    earlier ranges. The ranges' bounds come from at most RANGE_SAMPLE keys; they decide how even the ranges are, not the numbers.
    """
    groups = ws.save("groups", groups.select("t", "first"))
    some = F.pmod(F.xxhash64("first"), F.lit(1 << 30)) < (1 << 30) * min(1.0, RANGE_SAMPLE / max(groups.count(), 1))
    sample = sorted(r[0] for r in groups.where(F.col("first").isNotNull() & some).select("first").limit(2 * RANGE_SAMPLE).collect())
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    before = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("first"))) if bounds else F.lit(0)
    groups = groups.withColumn("part", F.coalesce(before, F.lit(0)))
    sizes = groups.groupBy("part").agg(F.count_distinct("first").alias("n"))  # at most one row per range
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    place = F.dense_rank().over(Window.partitionBy("part").orderBy("first")).cast("long") - 1
    return groups.withColumn("place", place).join(offsets, "part").select("t", (F.col("offset") + F.col("place")).alias("group_no"))


def group_numbers(df: DataFrame, ws: Workspace, key: str = "review_id") -> DataFrame:
    """key, group_no: dense numbers of the texts that occur again, in the order of their first keys. A null text is in no group."""
    t = F.sha2("text", 256)
    found = df.where("text is not null").groupBy(t.alias("t")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.select(F.col(key), t.alias("t")).join(spread(ordinals(found, ws)), "t").select(key, "group_no")


def cluster_numbers(clusters: DataFrame, ws: Workspace) -> DataFrame:
    """id, cluster, cluster_no of clusters (id, cluster): numbers from 0 in the order in which clusters are first met by id."""
    numbers = ordinals(clusters.groupBy(F.col("cluster").alias("t")).agg(F.min("id").alias("first")), ws).withColumnRenamed("t", "cluster")
    return clusters.join(spread(numbers), "cluster").select("id", "cluster", F.col("group_no").alias("cluster_no"))


def signatures(texts: list[str], hashes: int) -> np.ndarray:
    """The MinHash signature of the lower-case character trigrams of each text (3 characters at least): one row of `hashes` minima.

    A trigram is hashed once to 32 bits; each hash function is an exclusive or and an odd multiplier. Texts are taken together up
    to a size that stays in a processor's cache; a minimum needs no distinct trigrams.
    """
    rng = np.random.default_rng(1)
    flip = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    factor = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(texts), hashes), np.uint32)
    at = 0
    while at < len(texts):
        grams, end, total = [], at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= 1 << 15):
            grams.append(trigrams(texts[end]))
            total += len(grams[-1])
            end += 1
        first = np.concatenate(([0], np.cumsum([len(g) for g in grams[:-1]]))).astype(np.int64)
        x = np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)
        x = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for k in range(hashes):
            np.bitwise_xor(x, flip[k], out=y)
            np.multiply(y, factor[k], out=y)
            out[at:end, k] = np.minimum.reduceat(y, first)
        at = end
    return out


def trigrams(text: str) -> np.ndarray:
    """The lower-case trigrams of a text in order, as three code points of 21 bits."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]


def _banded(texts: list[str | None], bands: int, rows: int) -> list[np.ndarray | None]:
    """A 64-bit key per band; none for a text without trigrams."""
    long = [i for i, t in enumerate(texts) if t and len(t.lower()) >= 3]
    out: list[np.ndarray | None] = [None] * len(texts)
    if long:
        sig = signatures([texts[i] for i in long], bands * rows).astype(np.uint64).reshape(len(long), bands, rows)
        keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            keys = (keys ^ sig[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            keys ^= keys >> np.uint64(32)
        for i, k in zip(long, keys.view(np.int64)):
            out[i] = k
    return out


def band_keys(df: DataFrame, key: str = "review_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id (the key as a string), bands array<long>: LSH keys of the MinHash signature of lower-case character trigrams.

    A batch is taken in slices of KEYED rows, so that of its texts and signatures few are held at once.
    """
    return df.select(F.col(key).cast("string").alias("id"), "text").mapInArrow(_keyed(bands, rows), "id string, bands array<long>")


def _keyed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, KEYED) for b in batches for i in range(0, b.num_rows, KEYED)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_banded(b.column(1).to_pylist(), bands, rows), pa.list_(pa.int64()))], ["id", "bands"])

    return run


def lsh_clusters(df: DataFrame, ws: Workspace, key: str = "review_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, cluster for every row that shares a band with another; candidates aren't verified. bands and rows: see `parameters`.

    A bucket is a star around its smallest id, so no pairs are formed.
    """
    keyed = ws.save("bands", band_keys(df, key, bands, rows)).select("id", F.explode("bands").alias("h"))
    hubs = keyed.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    edges = keyed.join(spread(hubs), "h").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    found = ws.save("clusters", connected_components(ws, edges, "lsh").select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    ws.drop("bands")
    return found


def _with_clusters(df: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """df with is_duplicate and duplicate_cluster_id from clusters (id, cluster); no other column changes."""
    of, name = free_name(df, "cluster_id_of"), free_name(df, "cluster_name")
    c = clusters.select(F.col("id").alias(of), F.col("cluster").alias(name))
    out = df.join(c, F.col(f"`{key}`").cast("string") == F.col(of), "left")
    some = F.col(name).isNotNull()
    return out.withColumns({"is_duplicate": some, "duplicate_cluster_id": _cluster_number(some, F.col(name))}).drop(of, name)


def lsh(df: DataFrame, ws: Workspace, key: str = "review_id", threshold: float | None = None, hashes: int = 128) -> DataFrame:
    """df with is_duplicate (has a candidate, the first member included) and duplicate_cluster_id (-1 if none).

    All other columns stay. A text of fewer than 3 characters, a null text and a null key have no candidate; df is read twice.
    With a threshold, bands and rows are chosen for that and the number of hash functions.
    """
    bands, rows = (BANDS, ROWS) if threshold is None else parameters(threshold, hashes)
    return _with_clusters(df, lsh_clusters(df, ws, key, bands, rows), key)


def verified_clusters(df: DataFrame, ws: Workspace, key: str = "review_id", threshold: float = THRESHOLD, bands: int = VERIFIED_BANDS, rows: int = VERIFIED_ROWS) -> DataFrame:
    """id, cluster for every row whose text is equal to another row's or shares at least `threshold` of its trigrams (Jaccard).

    Candidates share a band of a longer signature than `lsh` has, and are then compared on their full sets (`linkage`); equal
    texts are one node. The chance that no band of a pair at exactly 0.8 agrees is 0.3 %, at 0.85 below 0.001 %.
    """
    rows_of = df.select(F.col(key).cast("string").alias("id"), "text").where("text is not null and id is not null")
    with_digest = rows_of.withColumn("t", F.sha2("text", 256))
    texts = ws.save("texts", with_digest.select("id", "t"))
    classes = texts.groupBy("t").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"))
    classes = ws.save("classes", classes.withColumn("node", F.monotonically_increasing_id()))
    one = ws.save("one", with_digest.join(classes.select("t", "id", "node"), ["t", "id"]).dropDuplicates(["t", "id"]).select("node", "text"))  # a text moves once
    banded = ws.save("bands", band_keys(one, "node", bands, rows)).select(F.col("id").cast("long").alias("node"), F.explode("bands").alias("key"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [np.unique(trigrams(t)) for t in b.column(1).to_pylist()]
                yield linkage.sketched(b.column(0), sets)

        return one.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(run, linkage.SKETCHED)

    found = similar_components(ws, banded, sets_of, round(100 * threshold), spent=("one", "bands"), sketches=True)
    named = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", F.when(F.col("copies") > 1, F.col("node")))).where("component is not null")
    least = named.groupBy("component").agg(F.min("id").alias("cluster"))
    named = ws.save("named", named.join(spread(least), "component").select("t", "cluster"))
    out = ws.save("clusters", texts.select("id", "t").join(spread(named), "t").groupBy("id").agg(F.min("cluster").alias("cluster")))
    for name in ("texts", "classes", "named"):
        ws.drop(name)
    return out


def verified(df: DataFrame, ws: Workspace, key: str = "review_id", threshold: float = THRESHOLD) -> DataFrame:
    """As `lsh`, but every link is confirmed on the full trigram sets."""
    return _with_clusters(df, verified_clusters(df, ws, key, threshold), key)


def _trigram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> id, n, elements, sketch: the distinct lower-case trigrams and their parities; texts of fewer than 3 characters are left out."""
    for b in batches:
        rows = [i for i, t in enumerate(b.column(1).to_pylist()) if t and len(t.lower()) >= 3]
        sets = [np.unique(trigrams(b.column(1)[i].as_py())) for i in rows]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([x.tobytes() for x in of], pa.binary()) for of in (sets, map(sketch, sets)))], ["id", "n", "elements", "sketch"])


def sketch(elements: np.ndarray) -> np.ndarray:
    """PARITY bits: the parity of the elements in each of as many hash classes."""
    at = (elements * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PARITY.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8))


def _signs(sketches: list[bytes]) -> np.ndarray:
    """A row of 1 (even) and -1 (odd) per sketch."""
    bits = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8)).reshape(len(sketches), PARITY)
    return 1 - 2 * bits.astype(np.float32)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PARITY numbers of 1 or -1 per set: the parity of its elements in each of as many hash classes."""
    return _signs([sketch(x).tobytes() for x in sets])


def possible(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs can reach the threshold: parities differ in no more classes than the sets have elements of their own.

    A pair of similarity t or more has at most (1 - t) / (1 + t) of both sets' elements outside the intersection, and sizes of ratio t.
    """
    n_l, n_r = (np.array([len(x) for x in side], np.float32) for side in (left, right))
    return reachable((PARITY - parities(left) @ parities(right).T) / 2, n_l, n_r, threshold)


def reachable(differ: np.ndarray, n_l: np.ndarray, n_r: np.ndarray, threshold: float) -> np.ndarray:
    """`possible` from the numbers of different parities and of elements."""
    both = n_l[:, None] + n_r[None, :]
    near = differ <= (1 - threshold) / (1 + threshold) * both + 1e-3
    return near & (np.minimum(n_l[:, None], n_r[None, :]) >= threshold * np.maximum(n_l[:, None], n_r[None, :]) - 1e-3)


def shared_elements(left: list[np.ndarray], right: list[np.ndarray], ask: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs asked for (0 for the others): one by one if those are few, else of all at once."""
    if ask.mean() > DENSE:
        return np.where(ask, intersections(left, right), 0)
    out = np.zeros(ask.shape, np.int64)
    for i, j in zip(*np.nonzero(ask)):
        out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    return out


def _similar(threshold: float, count: bool = False):
    """Rows in the order of (low, high, i, j): those, side, id, elements -> a, b, shared, total of the pairs that reach the threshold.

    With count only id, n: how many links of each set are in the group.
    """

    def pairs(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
        if not left or not right:
            return
        sets_l, sets_r = ([np.frombuffer(r[2], "<u8") for r in side] for side in (left, right))
        ask = possible(sets_l, sets_r, threshold)
        if rows[0][0] == 2:
            ask = np.triu(ask, 1)
        if not ask.any():
            return
        both = shared_elements(sets_l, sets_r, ask)
        total = np.array([len(x) for x in sets_l])[:, None] + np.array([len(x) for x in sets_r])[None, :] - both
        hit = ask & (both >= threshold * total - 1e-9)
        if count:
            for side, n in ((left, hit.sum(axis=1)), (right, hit.sum(axis=0))):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([side[i][1] for i in at.tolist()], kind), pa.array(n[at].astype(np.int64))], ["id", "n"])
            return
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            at = np.flatnonzero(hit[i])
            ends = [sorted((left[i][1], right[j][1])) for j in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], kind), pa.array([y for _, y in ends], kind), pa.array(both[i, at].astype(np.int64)), pa.array(total[i, at].astype(np.int64))], ["a", "b", "shared", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kind = None, [], pa.null()
        for batch in batches:
            kind = batch.column(5).type
            for *group, side, key, elements in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now:
                    yield from pairs(rows, kind)
                    now, rows = group, []
                rows.append((side, key, elements))
        yield from pairs(rows, kind)

    return run


def _meetings(threshold: float):
    """Rows in the order of (low, high, p, q): those, side, id, own, n, sketch -> low, high, i, j, side, id: the blocks that each set meets with a chance.

    A chance is what parities leave (`reachable`), so a set without one in a pair of blocks stays out of it. The counts of different
    parities are formed for MATRIX pairs at a time.
    """

    def meet(group: tuple, rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        left, right = ([r for r in rows if r[0] != other] for other in (1, 0))
        if not left or not right:
            return
        left, right = (sorted(side, key=lambda r: r[2]) for side in (left, right))
        same = rows[0][0] == 2
        own_l, own_r = (np.array([r[2] for r in side], np.int64) for side in (left, right))
        n_l, n_r = (np.array([r[3] for r in side], np.float32) for side in (left, right))
        signs = _signs([r[4] for r in right])
        first = np.flatnonzero(np.diff(own_r, prepend=-1))
        begin = np.flatnonzero(np.diff(own_l, prepend=-1))
        back = np.zeros((len(begin), len(right)), bool)  # blocks of the left side that a set of the right one meets
        step = max(1, MATRIX // len(right))
        for at in range(0, len(left), step):
            ask = reachable((PARITY - _signs([r[4] for r in left[at : at + step]]) @ signs.T) / 2, n_l[at : at + step], n_r, threshold)
            if same:
                here = np.arange(at, at + len(ask))
                ask[here - at, here] = False
            row, block = np.nonzero(np.logical_or.reduceat(ask, first, axis=1))
            if same:
                other, mine = own_r[first[block]], own_l[at + row]
                yield out(group, np.minimum(mine, other), np.maximum(mine, other), np.where(mine == other, 2, np.where(mine < other, 0, 1)), [left[i][1] for i in (at + row).tolist()], kind)
                continue
            yield out(group, own_l[at + row], own_r[first[block]], np.zeros(len(row), np.int64), [left[i][1] for i in (at + row).tolist()], kind)
            of = np.searchsorted(begin, np.arange(at, at + len(ask)), "right") - 1
            cut = np.flatnonzero(np.diff(of, prepend=-1))
            back[of[cut]] |= np.logical_or.reduceat(ask, cut, axis=0)
        if not same:
            block, row = np.nonzero(back)
            yield out(group, own_l[begin[block]], own_r[row], np.ones(len(row), np.int64), [right[i][1] for i in row.tolist()], kind)

    def out(group: tuple, i: np.ndarray, j: np.ndarray, side: np.ndarray, ids: list, kind: pa.DataType) -> pa.RecordBatch:
        low, high = (pa.array(np.full(len(i), x, np.int32)) for x in group[:2])
        return pa.RecordBatch.from_arrays([low, high, *(pa.array(x.astype(np.int32)) for x in (i, j, side)), pa.array(ids, kind)], ["low", "high", "i", "j", "side", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kind = None, [], pa.null()
        for batch in batches:
            kind = batch.column(5).type
            for low, high, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (low, high, p, q) != now:
                    yield from meet(now, rows, kind)
                    now, rows = (low, high, p, q), []
                rows.append(tuple(row))
        yield from meet(now, rows, kind)

    return run


def _places(own: str, blocks: str) -> Column:
    """low, high, p, q, side of the pairs of blocks that a set takes part in: those of its band of sizes and of the two next to it.

    own is the set's block; blocks the number in its band, above and below (prefixed) those in the next ones.
    """
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda low, high, p, q, side: F.struct(low.alias("low"), high.alias("high"), p.alias("p"), q.alias("q"), side.alias("side"))
    me, band = F.col(own), F.col("band")
    same = F.transform(upto(F.col(blocks)), lambda x: place(band, band, F.least(me, x), F.greatest(me, x), F.when(me == x, 2).when(me < x, 0).otherwise(1)))
    up = F.transform(upto(F.col(f"above_{blocks}")), lambda x: place(band, band + 1, me, x, F.lit(0)))
    down = F.transform(upto(F.col(f"below_{blocks}")), lambda x: place(band - 1, band, x, me, F.lit(1)))
    return F.concat(same, up, down)


def _compared(df: DataFrame, ws: Workspace, key: str, threshold: float, run: Callable, schema: str) -> DataFrame:
    """What run finds in the trigram sets of different texts: low, high, i, j, side, id, elements in the order of the first four; saved.

    Copies of a text are represented by their smallest key. Trigrams are too few for rare ones to tell texts apart, so every
    set is compared with all of about its size: sizes fall into geometric bands, and of two similar sets one's band is
    the other's or the next. What is dealt out to all pairs of large blocks are sketches of PARITY bits; full sets go only to those
    pairs of small blocks, bounded in rows and elements, in which their sketch leaves them a chance. Both are dealt in slices whose
    shuffles are gone before the next one: of DEALT sketches a set, and of a full set for every fourth one.
    """
    first = df.where("text is not null").groupBy(F.sha2("text", 256).alias("t")).agg(F.min(key).alias("first")).select("first")
    texts = df.join(first.hint("merge"), df[key] == first["first"], "left_semi").where("text is not null").groupBy(F.col(key).alias("id")).agg(F.min("text").alias("text"))
    kind = dict(df.dtypes)[key]
    sets = texts.mapInArrow(_trigram_sets, f"id {kind}, n long, elements binary, sketch binary")
    sets = ws.save("sets", sets.withColumn("band", F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).cast("int")))
    rows = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(F.sum("n") / linkage.BLOCK), F.ceil(rows / linkage.ROWS)).cast("int")
    bands = ws.save("bands", sets.groupBy("band").agg(blocks.alias("blocks"), F.ceil(rows / SKETCHES).cast("int").alias("large"), rows.alias("rows")))  # a row per band of sizes
    beside = [bands.select((F.col("band") + by).alias("band"), F.col("large").alias(f"{name}_large")) for by, name in ((-1, "above"), (1, "below"))]
    bands = ws.save("beside", reduce(lambda a, b: a.join(b, "band", "left"), beside, bands))
    total = bands.agg(F.sum("rows"), F.sum(F.col("rows") * (F.col("large") + F.coalesce("above_large", F.lit(0)) + F.coalesce("below_large", F.lit(0))))).first()
    count, deals = total[0] or 0, total[1] or 0

    own = sets.select("id", "n", "band", "sketch").join(F.broadcast(bands), "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = own.withColumn("me", F.floor(F.col("own") * F.col("large") / F.col("blocks")).cast("int")).withColumn("at", _places("me", "large"))
    group, slices = ["low", "high", "p", "q"], max(1, math.ceil(deals / max(linkage.SLICE, DEALT * count)))
    met = []
    for k in range(slices):
        mine = F.filter("at", lambda x: F.pmod(F.xxhash64(*[x[c] for c in group]), F.lit(slices)) == k)
        dealt = own.select(F.explode(mine).alias("at"), "id", "own", "n", "sketch").select("at.*", "id", "own", "n", "sketch")
        dealt = dealt.repartition(*group).sortWithinPartitions(*group)
        met.append(ws.save(f"met-{k}", dealt.mapInArrow(_meetings(threshold), f"low int, high int, i int, j int, side int, id {kind}")))
    met = reduce(DataFrame.unionByName, met)

    live = ws.save("live", sets.select("id", "elements").join(met.select("id").distinct().hint("merge"), "id", "left_semi"))
    ws.drop("sets")
    group, slices = ["low", "high", "i", "j"], max(1, math.ceil(met.count() / max(linkage.SLICE, count // 4)))
    found = []
    for k in range(slices):
        mine = met.where(F.pmod(F.xxhash64(*group), F.lit(slices)) == k).join(live.hint("merge"), "id").select(*group, "side", "id", "elements")
        found.append(ws.save(f"found-{k}", mine.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)))
    ws.drop("live")
    return reduce(DataFrame.unionByName, found)


def jaccard_pairs(df: DataFrame, ws: Workspace, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """a, b, jaccard for all pairs of different texts with trigram similarity >= threshold; exact.

    Copies of a text are represented by their smallest key. Pairs are pruned by parities of hashed elements
    first, so full sets move and are compared only where those leave a chance. The number of pairs still grows with the square of a
    band, in time and not on disk; `verified_clusters` is the form for large tables.
    """
    kind = dict(df.dtypes)[key]
    found = _compared(df, ws, key, threshold, _similar(threshold), f"a {kind}, b {kind}, shared long, total long")
    return found.select("a", "b", F.round(F.col("shared") / F.col("total"), 6).alias("jaccard"))


def jaccard_documents(df: DataFrame, ws: Workspace, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id, n_links for every row: the smallest key of its equal texts, and how many other classes are as similar as `jaccard_pairs` has it. Pairs are counted where they are found and never become rows.

    A null text is a class by itself.
    """
    kind, own, n, t, first = dict(df.dtypes)[key], *(free_name(df, x) for x in ("linked_id", "links_of", "text_digest", "first_key"))
    each = _compared(df, ws, key, threshold, _similar(threshold, count=True), f"id {kind}, n long")
    links = ws.save("links", each.groupBy(F.col("id").alias(own)).agg(F.sum("n").alias(n)))
    firsts = df.where("text is not null").groupBy(F.sha2("text", 256).alias(t)).agg(F.min(key).alias(first))
    classes = df.select(key, F.sha2("text", 256).alias(t)).join(spread(firsts), t, "left").select(key, F.coalesce(first, key).alias("class_id"))
    out = classes.join(spread(links), F.col("class_id") == F.col(own), "left")
    return out.select(key, "class_id", F.coalesce(n, F.lit(0)).alias("n_links"))
