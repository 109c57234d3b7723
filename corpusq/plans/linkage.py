"""Components of similar sets, from candidate buckets, without ever forming a bucket's pairs.

1. A bucket of two or more nodes is a star around its smallest node. Every node keeps one star edge
   at first. A star is dealt out in parts of at most ROWS members and about BLOCK elements, its centre
   goes with each part, and a part is compared inside a task. Components of the confirmed edges follow.
2. A bucket whose nodes are all in one component needs nothing more. In the others a component that has most of the members
   meets the other members only, and these each other, inside tasks by pairs of blocks; of a block's links only those that join
   components come out. Sets are dealt in slices of about a set per node, whose shuffles are gone before the next one.
   Components of all confirmed edges are the result.
3. Where many candidates aren't similar (`sketches`), step 2 compares parities of hashed elements first, which never leaves a link out, and
   deals full sets of an eighth of the block pairs before those of the others that still join components.

Intersections of two blocks are counted per element: an element that few members hold adds to their
pairs only, one that many hold goes into a product of incidence matrices. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.plans.components import connected_components
from corpusq.plans.once import spread
from corpusq.plans.workspace import Workspace

ROWS = 1024
BLOCK = 1 << 19
STEP = 1 << 19
COLUMNS = 512
SLICE = 1 << 15
SKETCH = 2048  # bits of a sketch
DEALT = 4  # sketches of a set that are dealt out at once
EARLY = 8
SKETCHED = "node long, n long, elements binary, sketch binary"
PAIRS = 1 << 14  # pairs of sketches compared at once


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one; sets are distinct 64-bit integers."""
    n, m = len(left), len(right)
    row_l, row_r = (np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right))
    out = np.zeros(n * m, np.int32)
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at_l, at_r = place[: len(row_l)], place[len(row_l) :]
    held_l, held_r = np.bincount(at_l, minlength=len(values)), np.bincount(at_r, minlength=len(values))
    dense = (held_l * held_r) * 16 > n * m
    rare = (held_l > 0) & (held_r > 0) & ~dense

    by = np.argsort(at_r, kind="stable")
    row_by, first = row_r[by], np.concatenate(([0], np.cumsum(held_r)))
    mine = np.flatnonzero(rare[at_l])
    pairs = held_r[at_l[mine]]
    upto = np.concatenate(([0], np.cumsum(pairs)))
    i = 0
    while i < len(mine):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + STEP, "right")) - 1)
        k, total = pairs[i:j], int(upto[j] - upto[i])
        other = np.repeat(first[at_l[mine[i:j]]] - (upto[i:j] - upto[i]), k) + np.arange(total)
        flat = np.repeat(row_l[mine[i:j]], k) * m + row_by[other]
        if total * 4 < n * m:
            np.add.at(out, flat, 1)
        else:
            out += np.bincount(flat, minlength=n * m).astype(np.int32)
        i = j
    out = out.reshape(n, m)

    columns = np.flatnonzero(dense & (held_l > 0) & (held_r > 0))
    number = np.full(len(values), -1)
    number[columns] = np.arange(len(columns))
    for low in range(0, len(columns), COLUMNS):
        sides = []
        for size, row, at in ((n, row_l, at_l), (m, row_r, at_r)):
            inside = (number[at] >= low) & (number[at] < low + COLUMNS)
            a = np.zeros((size, COLUMNS), np.float32)
            a[row[inside], number[at[inside]] - low] = 1
            sides.append(a)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    return out


def links(rows: list[tuple], percent: int, forest: bool = False) -> pa.RecordBatch | None:
    """a, b: confirmed links between members of different components, one per node and component; `forest`: only those that join components not yet joined.

    rows: (side, node, component, elements); side 0 left, 1 right, 2 both.
    """
    left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
    if not left or not right:
        return None
    comp_l, comp_r = (np.array([r[2] for r in side], np.int64) for side in (left, right))
    if comp_l.min() == comp_l.max() == comp_r.min() == comp_r.max():
        return None
    sets_l, sets_r = ([np.frombuffer(r[3], "<u8") for r in side] for side in (left, right))
    both = intersections(sets_l, sets_r)
    n_l, n_r = (np.array([len(x) for x in sets], np.int64) for sets in (sets_l, sets_r))
    label, place = np.unique(np.concatenate((comp_l, comp_r)), return_inverse=True)
    of_l, of_r = place[: len(left)], place[len(left) :]
    a, b = [], []
    for i in range(len(left)):
        own = label[of_l[i]]
        hit = (both[i] > 0) & (100 * both[i].astype(np.int64) >= percent * (n_l[i] + n_r - both[i])) & (label[of_r] != own)
        at = np.flatnonzero(hit)
        if len(at):
            met, first = np.unique(label[of_r[at]], return_index=True)
            if forest:
                label[np.isin(label, met)] = own
            a += [left[i][1]] * len(met)
            b += [right[j][1] for j in at[first]]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((key, i, j), its other columns) of rows in the order of these."""
    now, rows = None, []
    for batch in batches:
        for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, i, j) != now:
                if rows:
                    yield now, rows
                now, rows = (key, i, j), []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _grouped(percent: int, forest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of (key, i, j): key, i, j, side, node, component, elements -> links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            if (out := links(rows, percent, forest)) is not None:
                yield out

    return run


def compared(dealt: DataFrame, sets: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """dealt: key, i, j, side, node, component; the sets join after the deal, so a set moves once per block it meets."""
    full = dealt.join(sets.select("node", "elements"), "node").select("key", "i", "j", "side", "node", "component", "elements")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_grouped(percent, forest), "a long, b long")


def sliced(ws: Workspace, name: str, dealt: DataFrame, sets: DataFrame, percent: int, forest: bool = True) -> DataFrame:
    """`compared` of the saved table dealt, in so many slices that each set is dealt about once in a slice, which has SLICE deals at least; saved."""
    slices = max(1, round(dealt.count() / max(SLICE, sets.count())))
    of = F.pmod(F.xxhash64("key", "i", "j"), F.lit(slices))
    return reduce(DataFrame.unionByName, [ws.save(f"{name}-{i}", compared(dealt.where(of == i), sets, percent, forest)) for i in range(slices)])


def sketch(elements: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """The parity of the elements in each of `bits` hash classes (a power of 2), packed."""
    at = (elements * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def sketched(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    """node, n, elements, sketch (SKETCHED) of sets of distinct 64-bit integers."""
    return pa.RecordBatch.from_arrays([nodes, pa.array([len(x) for x in sets], pa.int64()), *(pa.array([x.tobytes() for x in of], pa.binary()) for of in (sets, map(sketch, sets)))], ["node", "n", "elements", "sketch"])


def _alive(place: np.ndarray, side: np.ndarray, component: np.ndarray, n: np.ndarray, words: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a chance with a row of another component across their block pair; place: where a block pair's rows begin, which are ordered by side.

    Two sets of sizes a and b that reach the threshold differ in at most (100 - percent) / (100 + percent) of a + b elements, and so in no more parities.
    """
    count = len(side)
    end = np.append(place[1:], count)
    of = np.repeat(np.arange(len(place)), end - place)
    rights = place + np.add.reduceat(side == 0, place)
    low = np.where(side == 2, np.arange(count) + 1, rights[of])
    partners = np.where(side == 1, 0, end[of] - low)
    upto = np.concatenate(([0], np.cumsum(partners)))
    out = np.zeros(count, bool)
    i = 0
    while i < count:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
        k = partners[i:j]
        a = np.repeat(np.arange(i, j), k)
        b = np.repeat(low[i:j] - (upto[i:j] - upto[i]), k) + np.arange(len(a))
        both = n[a] + n[b]
        ask = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b, both = a[ask], b[ask], both[ask]
        differ = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * differ <= (100 - percent) * both
        out[a[near]] = out[b[near]] = True
        i = j
    return out


def _chances(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of (key, i, j, side, node): those, component, n, sketch -> the first six of the nodes with a chance. A block pair is held whole, sketches only."""
    names = ["key", "i", "j", "side", "node", "component"]

    def judged(t: pa.Table) -> pa.RecordBatch:
        key, i, j, side, node, component, n = (t.column(c).to_numpy() for c in range(7))
        words = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(key), -1)
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        alive = _alive(np.flatnonzero(new), side, component, n, words, percent)
        first = np.flatnonzero(new | np.concatenate(([True], node[1:] != node[:-1])))  # a node may have several sets
        first = first[np.logical_or.reduceat(alive, first)]
        return pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (key, i, j, side, node, component)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key, i, j = (b.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if last is not None and last != (key[0], i[0], j[0]):
                cuts = np.concatenate(([0], cuts))
            last = key[-1], i[-1], j[-1]
            if len(cuts):
                done = [*rest, b.slice(0, cuts[-1])]
                if sum(x.num_rows for x in done):
                    yield judged(pa.Table.from_batches(done))
                rest = []
                b = b.slice(cuts[-1])
            rest.append(b)
        if rest:
            yield judged(pa.Table.from_batches(rest))

    return run


def chances(ws: Workspace, name: str, dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the saved table dealt (see `compared`) the rows of nodes that their sketches leave a chance in their block pair; saved.

    None that has a link is left out. Sketches are dealt in slices of at most DEALT a set.
    """
    count = max(SLICE, sets.count())
    slices = max(1, round(dealt.count() / (DEALT * count)))
    small, of = sets.select("node", "n", "sketch"), F.pmod(F.xxhash64("key", "i", "j"), F.lit(slices))
    out = []
    for k in range(slices):
        full = dealt.where(of == k).join(small, "node").select("key", "i", "j", "side", "node", "component", "n", "sketch")
        full = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
        out.append(ws.save(f"{name}/{k}", full.mapInArrow(_chances(percent), "key long, i int, j int, side int, node long, component long")))
    return reduce(DataFrame.unionByName, out)


def places(rest: DataFrame, among: bool = True) -> DataFrame:
    """key, i, j, side, node, component from rest (key, node, component, fresh, new, old): fresh members meet the others and, with `among`, each other.

    new and old are the numbers of blocks of the fresh members of the bucket and of the others.
    """
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("fresh"), F.col("new")).otherwise(F.col("old"))).cast("int"))
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.col("own")
    with_old = F.transform(upto(F.col("old")), lambda x: place(own, F.col("new") + x, F.lit(0)))
    with_new = F.transform(upto(F.col("new")), lambda x: place(F.least(own, x), F.greatest(own, x), F.when(own == x, 2).when(own < x, 0).otherwise(1)))
    of_old = F.transform(upto(F.col("new")), lambda x: place(x, F.col("new") + own, F.lit(1)))
    dealt = rest.select("key", "node", "component", F.explode(F.when(F.col("fresh"), F.concat(with_old, with_new) if among else with_old).otherwise(of_old)).alias("at"))
    return dealt.select("key", "at.i", "at.j", "at.side", "node", "component")


def block_parts() -> Column:
    """How many parts a group of sets needs (an aggregate over n)."""
    return F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count(F.lit(1)) / ROWS)).cast("int")


def similar_components(ws: Workspace, keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, spent: Sequence[str] = (), sketches: bool = False) -> DataFrame:
    """(node, component) of the nodes that are linked with another: 100 * intersection >= percent * union.

    keyed: key long, node long, the candidate buckets. sets_of(nodes): node, n long, elements binary (distinct
    little-endian 64-bit integers) of the given nodes, for those that share a bucket. component is the smallest node.
    spent: tables of ws that are dropped once the sets are written. sketches: sets_of has the column sketch too (`sketched`), for buckets of many members that aren't similar;
    then a node's star is that of the centre it meets most often, and sketches are compared before full sets are dealt to blocks.
    """
    stars = keyed.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").drop("last")
    members = ws.save("members", keyed.join(spread(stars), "key").select("key", "node", "center"))
    sets = ws.save("sets", sets_of(members.select("node").distinct()))
    for name in spent:
        ws.drop(name)
    sizes = sets.groupBy("node").agg(F.sum("n").alias("n"))  # a node may have several sets

    first = members.where("node <> center")
    if sketches:
        first = first.groupBy("node", "center").agg(F.count(F.lit(1)).alias("m")).groupBy("node").agg(F.max_by("center", F.struct("m", "center")).alias("key"))
    else:
        first = first.groupBy("node").agg(F.min("center").alias("key"))
    first = first.join(sizes, "node")
    parts = first.groupBy("key").agg(block_parts().alias("parts"))
    first = first.join(spread(parts), "key")
    rim = first.select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "node", F.col("node").alias("component"))
    hub = parts.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("key").alias("node"), F.col("key").alias("component"))
    stars = rim.unionByName(hub)
    if sketches:
        stars = chances(ws, "near-stars", ws.save("stars", stars), sets, percent)
    confirmed = ws.save("links-1", compared(stars, sets, percent))
    for name in ("stars", "near-stars"):
        ws.drop(name)
    found = ws.save("found-1", connected_components(ws, confirmed, "cc-a"))

    labelled = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = ws.save("labelled", labelled.join(sizes, "node"))
    ws.drop("members")
    each = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    main = F.max_by(F.struct("component", "m", "n"), F.struct("m", "component")).alias("main")
    mixed = each.groupBy("key").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), main, F.count(F.lit(1)).alias("components")).where("components > 1")
    most = F.col("main.m") * 2 > F.col("m")
    blocks = lambda n, m: F.greatest(F.ceil(n / BLOCK), F.ceil(m / ROWS)).cast("int")
    of_main = lambda c: F.when(most, F.col(f"main.{c}")).otherwise(0)
    mixed = mixed.select("key", F.when(most, F.col("main.component")).alias("main"), blocks(F.col("n") - of_main("n"), F.col("m") - of_main("m")).alias("new"), F.when(most, blocks(F.col("main.n"), F.col("main.m"))).otherwise(0).alias("old"))
    rest = labelled.join(spread(mixed), "key").withColumn("fresh", ~F.col("component").eqNullSafe(F.col("main")))
    dealt = ws.save("dealt", places(rest))
    if sketches:
        found, dealt = _closer(ws, found, dealt, sets, percent)
    more = sliced(ws, "links-2", dealt, sets, percent)
    for name in ("labelled", "sets", "dealt", "left"):
        ws.drop(name)
    return connected_components(ws, _edges(found).unionByName(more), "cc-b")


def _edges(found: DataFrame) -> DataFrame:
    return found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _closer(ws: Workspace, found: DataFrame, dealt: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(components, what of the saved table dealt is still to be compared).

    Similar sets share many buckets, so one in EARLY of the block pairs finds most links; of the others what remains are those whose nodes are
    then in different components and have a chance.
    """
    near = chances(ws, "near", dealt, sets, percent)
    ws.drop("dealt")
    early = F.pmod(F.xxhash64("key", "i", "j", F.lit(1)), F.lit(EARLY)) == 0
    links_of = sliced(ws, "links-early", ws.save("early", near.where(early)), sets, percent)
    found = ws.save("found-2", connected_components(ws, _edges(found).unionByName(links_of), "cc-early"))
    now = found.withColumnRenamed("component", "now")
    rest = ws.save("rest", near.where(~early).join(now, "node", "left").withColumn("component", F.coalesce("now", "component")).drop("now"))
    left = chances(ws, "left", rest, sets, percent)
    for name in ("near", "early", "rest"):
        ws.drop(name)
    return found, left
