"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits recursively at the median along a random direction; vectors within a margin of the
split go to both sides (spill), so close vectors rarely part. The upper levels' thresholds are fitted on
a bounded sample of SAMPLE vectors; a tree is a few numbers per node (directions come from a seed), and
every vector is routed through all trees. A leaf that still has more than MOST members is split again,
by a subtree of up to SPLITS nodes fitted on a sample of its own in a task, and so on level by level, so leaves
don't grow with the table. Vectors that share a leaf are compared in double precision.

A pair can share several leaves; it counts in the first one only, which each leaf can tell from its
members' lists of leaves, so links are counted without forming pairs: a leaf yields one row per
vector with its count and the smallest id of its component there. Equal vectors are one node with a
multiplicity beforehand. A leaf that no direction splits, one of near copies, stays whole; with more than
BLOCK members it is dealt out as pairs of blocks, so no task holds it.

With margin MARGIN / sqrt(dimension) a pair at cosine 0.95 is parted by a split with a probability of
about 0.02 in isotropic data (much less for closer pairs), by a tree of 8 levels 0.15, by all TREES
trees below 1e-6; by trees of 20 levels 0.33 and 1.5e-4.

Defined results: a vector that is null, empty, zero or has a null or non-finite component links with
nothing and is kept; vectors of different length aren't compared; rows that share both id and vector
are one vector; a row without an id takes no part (n_links 0, component_id null, kept false); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.plans.components import connected_components
from corpusq.plans.once import spread
from corpusq.plans.workspace import Workspace

THRESHOLD = 0.95
TREES = 8
MARGIN = 0.16
SAMPLE = 16_384
LEAF = 1024
LEAST = 24
MOST = 4096
BLOCK = 4096
SPLITS = 63
SUB_SAMPLE = 2048
ROUNDS = 12


def unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, "<f8")
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding array<double> -> vec_id, d1, d2, dim, raw (null if it links with nothing)."""
    for b in batches:
        raw, d1, d2, dim = [], [], [], []
        for x in b.column(1):
            v = None if not x.is_valid or x.values.null_count else np.asarray(x.values.to_numpy(zero_copy_only=False), "<f8")
            if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                for out in (raw, d1, d2, dim):
                    out.append(None)
                continue
            raw.append((v + 0.0).tobytes())
            digest = xxhash.xxh3_128_digest(raw[-1])
            d1.append(int.from_bytes(digest[:8], "little", signed=True))
            d2.append(int.from_bytes(digest[8:], "little", signed=True))
            dim.append(len(v))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "d1", "d2", "dim", "raw"])


def split(p: np.ndarray, margin: float) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(threshold, left, right) of projections, split at their median with spill; None if that hardly parts them."""
    cut = float(np.median(p))
    left, right = p <= cut + margin, p >= cut - margin
    return (cut, left, right) if max(left.sum(), right.sum()) <= 0.85 * len(p) else None


@dataclass
class Tree:
    """Nodes by number: threshold, children (left, right) or a leaf number, arrays once fitted; a node's direction follows from seed and number."""

    seed: int
    dim: int
    cut: list[float] = field(default_factory=list)
    kids: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    def direction(self, node: int) -> np.ndarray:
        v = np.random.default_rng((self.seed, self.dim, node)).standard_normal(self.dim)
        return v / np.linalg.norm(v)

    def margin(self) -> float:
        return MARGIN / np.sqrt(self.dim)

    def fit(self, x: np.ndarray, size: int, first_leaf: int) -> int:
        """Split the sample until a leaf has at most `size` rows; returns the next free leaf number."""
        todo, leaf = [(self.add(), np.arange(len(x)))], first_leaf
        while todo:
            node, rows = todo.pop()
            if len(rows) > size and (parts := split(x[rows] @ self.direction(node), self.margin())):
                self.cut[node] = parts[0]
                self.kids[node] = (self.add(), self.add())
                todo += [(self.kids[node][0], rows[parts[1]]), (self.kids[node][1], rows[parts[2]])]
                continue
            self.leaf[node] = leaf
            leaf += 1
        self.cut, self.kids, self.leaf = np.array(self.cut), np.array(self.kids, np.int32), np.array(self.leaf, np.int32)
        return leaf

    def add(self) -> int:
        self.cut.append(0.0)
        self.kids.append((-1, -1))
        self.leaf.append(-1)
        return len(self.cut) - 1

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves that rows of x reach."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                yield int(self.leaf[node]), rows
                continue
            p = x[rows] @ self.direction(node)
            todo.append((int(self.kids[node][0]), rows[p <= self.cut[node] + self.margin()]))
            todo.append((int(self.kids[node][1]), rows[p >= self.cut[node] - self.margin()]))


def grow(classes: DataFrame, seed: int = 11) -> dict[int, list[Tree]]:
    """The forest of each vector length, fitted on at most SAMPLE vectors."""
    n = classes.count()
    some = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < (1 << 30) * min(1.0, 1.2 * SAMPLE / max(n, 1))  # no task sends more than its share
    sample = classes.where(some).select("dim", "raw", "node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("dim", "raw").toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for dim, raw in zip(sample["dim"].to_pylist(), sample["raw"].to_pylist()):
        by_dim.setdefault(dim, []).append(unit(raw))
    size, leaf, out = max(LEAST, LEAF * sample.num_rows // max(n, 1)), 0, {}
    for dim, rows in sorted(by_dim.items()):
        x = np.array(rows)
        out[dim] = []
        for t in range(TREES):
            tree = Tree(seed + t, dim)
            leaf = tree.fit(x, size, leaf)
            out[dim].append(tree)
    return out


def leaves_of(forest: dict[int, list[Tree]], dims: list[int], raws: list[bytes]) -> list[list[int]]:
    """Sorted leaves of each vector; a length that the sample lacks has one leaf of its own."""
    out: list[list[int]] = [[] for _ in raws]
    for dim in set(dims):
        at = [i for i, d in enumerate(dims) if d == dim]
        if dim not in forest:
            for i in at:
                out[i].append(-dim)
            continue
        x = np.array([unit(raws[i]) for i in at])
        for tree in forest[dim]:
            for leaf, rows in tree.route(x):
                for r in rows.tolist():
                    out[at[r]].append(leaf)
    return [sorted(x) for x in out]


class Subtree:
    """The splits of one large leaf, as a heap: node k has children 2k and 2k + 1, and a threshold or none (NaN)."""

    def __init__(self, leaf: int, dim: int, cuts: np.ndarray | None = None) -> None:
        self.leaf, self.dim, self.margin = leaf, dim, MARGIN / np.sqrt(dim)
        self.cuts = np.full(SPLITS + 1, np.nan) if cuts is None else cuts
        self.known: dict[int, np.ndarray] = {}

    def direction(self, k: int) -> np.ndarray:
        if k not in self.known:
            v = np.random.default_rng((self.leaf & ((1 << 64) - 1), k)).standard_normal(self.dim)
            self.known[k] = v / np.linalg.norm(v)
        return self.known[k]

    def fit(self, x: np.ndarray, size: int) -> np.ndarray:
        """The thresholds, from a sample of the leaf, until a node has at most `size` sampled rows."""
        todo = [(1, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k <= SPLITS and len(rows) > size and (parts := split(x[rows] @ self.direction(k), self.margin)):
                self.cuts[k] = parts[0]
                todo += [(2 * k, rows[parts[1]]), (2 * k + 1, rows[parts[2]])]
        return self.cuts

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves of the subtree that rows of x reach; a leaf's name is a hash of this one's and its node."""
        todo = [(1, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if not len(rows):
                continue
            if k > SPLITS or np.isnan(self.cuts[k]):
                name = np.array([self.leaf, k], "<i8").tobytes()
                yield int.from_bytes(xxhash.xxh3_64_digest(name), "little", signed=True) if k > 1 else self.leaf, rows
                continue
            p = x[rows] @ self.direction(k)
            todo.append((2 * k, rows[p <= self.cuts[k] + self.margin]))
            todo.append((2 * k + 1, rows[p >= self.cuts[k] - self.margin]))


def _by_leaf(of: Callable[[int, list[tuple]], tuple | None], names: list[str], types: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by their first column, the leaf -> of(leaf, rows), one row per leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for leaf, *row in zip(*(c.to_pylist() for c in b.columns)):
                if leaf != now:
                    if rows and (out := of(now, rows)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names)
                    now, rows = leaf, []
                rows.append(tuple(row))
        if rows and (out := of(now, rows)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names)

    return run


def deepen(routed: DataFrame, ws: Workspace) -> DataFrame:
    """routed (node, copies, dim, raw, leaves) with leaves of at most about MOST members, except those that can't be split.

    A leaf's sample of about SUB_SAMPLE members meets in a task, which fits its subtree; the thresholds join the members,
    and those go on to the subtree's leaves. Nothing is read again for leaves that are small enough from the start.
    """

    def fitted(leaf: int, rows: list[tuple]) -> tuple | None:
        dim, size = rows[0][0], max(LEAST, LEAF * len(rows) // max(rows[0][2], 1))
        cuts = Subtree(leaf, dim).fit(np.array([unit(r[1]) for r in rows]), size)
        return None if np.isnan(cuts[1]) else (leaf, cuts.tolist())

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, rows, raws = b.column(0).to_numpy(), b.column(2).to_pylist(), b.column(3)
            to, at = [], []
            for x in np.unique(leaf).tolist():
                mine = np.flatnonzero(leaf == x)
                tree = Subtree(x, rows[mine[0]], np.array(b.column(4)[int(mine[0])].as_py(), float))
                for new, part in tree.route(np.array([unit(raws[int(i)].as_py()) for i in mine])):
                    to += [new] * len(part)
                    at += mine[part].tolist()
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column(1).take(picked), b.column(2).take(picked), raws.take(picked)], ["leaf", "node", "dim", "raw"])

    each = routed.select("node", F.explode("leaves").alias("leaf"))
    large = ws.save("large-0", each.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST))
    if large.isEmpty():
        return routed
    done = [each.join(large, "leaf", "left_anti").select("node", "leaf")]
    members = routed.select(F.explode("leaves").alias("leaf"), "node", "dim", "raw")
    members = ws.save("members-0", members.join(spread(large.select("leaf")), "leaf"))
    for i in range(1, ROUNDS + 1):
        share = F.pmod(F.xxhash64("node", "leaf", F.lit(i)), F.lit(1 << 30)) < F.lit(float(SUB_SAMPLE) * (1 << 30)) / F.col("n")
        some = members.join(spread(large), "leaf").where(share).select("leaf", "dim", "raw", "n")
        some = some.repartition("leaf").sortWithinPartitions("leaf", F.xxhash64("raw"))
        cuts = ws.save(f"cuts-{i}", some.mapInArrow(_by_leaf(fitted, ["leaf", "cuts"], [pa.int64(), pa.list_(pa.float64())]), "leaf long, cuts array<double>"))
        done.append(ws.save(f"whole-{i}", members.join(spread(cuts.select("leaf")), "leaf", "left_anti").select("node", "leaf")))
        if cuts.isEmpty():
            break
        parted = members.join(spread(cuts), "leaf").select("leaf", "node", "dim", "raw", "cuts").mapInArrow(moved, "leaf long, node long, dim int, raw binary")
        parted = ws.save(f"parted-{i}", parted)
        large = ws.save(f"large-{i}", parted.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST))
        done.append(parted.join(spread(large.select("leaf")), "leaf", "left_anti").select("node", "leaf"))
        if large.isEmpty():
            break
        members = ws.save(f"members-{i}", parted.join(spread(large.select("leaf")), "leaf"))
        ws.drop(f"members-{i - 1}")
        if i == ROUNDS:
            done.append(members.select("node", "leaf"))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    leaves = every.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    return ws.save("deepened", routed.drop("leaves").join(leaves, "node"))


def _earlier(leaf: int, left: list, right: list) -> np.ndarray:
    """Whether two members share a leaf before this one, as a matrix."""
    number: dict[int, int] = {}
    for x in {*left, *right}:
        for i in x:
            if i < leaf:
                number.setdefault(i, len(number))
    sides = []
    for side in (left, right):
        a = np.zeros((len(side), max(1, len(number))), np.float32)
        for r, x in enumerate(side):
            a[r, [number[i] for i in x if i < leaf]] = 1
        sides.append(a)
    return sides[0] @ sides[1].T > 0


def compare(leaf: int, rows: list[tuple]) -> pa.RecordBatch | None:
    """node, links, root of the members of a leaf, or of two of its blocks, that have links there.

    rows: (side, node, copies, raw, leaves); side 0 left, 1 right, 2 both.
    """
    left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
    if not left or not right:
        return None
    same = rows[0][0] == 2
    a, b = np.array([unit(r[3]) for r in left]), np.array([unit(r[3]) for r in right])
    close = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 512):
        close[i : i + 512] = a[i : i + 512] @ b.T >= THRESHOLD
    if same:
        np.fill_diagonal(close, False)
        close |= close.T
    in_l, in_r = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(in_l):
        return None
    close = close[np.ix_(in_l, in_r)]
    left, right = [left[i] for i in in_l], [right[i] for i in in_r]
    own = close & ~_earlier(leaf, [tuple(r[4]) for r in left], [tuple(r[4]) for r in right])
    node_l, node_r = (np.array([r[1] for r in side], np.int64) for side in (left, right))
    copies_l, copies_r = (np.array([r[2] for r in side], np.float64) for side in (left, right))
    root_l, root_r, far = node_l.copy(), node_r.copy(), np.int64((1 << 63) - 1)
    while True:  # least id of the components of these links
        new_r = np.minimum(root_r, np.array([root_l[close[:, j]].min(initial=far) for j in range(len(root_r))]))
        new_l = np.minimum(root_l, np.array([new_r[close[i]].min(initial=far) for i in range(len(root_l))]))
        done = (new_l == root_l).all() and (new_r == root_r).all()
        root_l, root_r = new_l, new_r
        if done:
            break
    nodes, links, roots = node_l.tolist(), (own @ copies_r).astype(np.int64).tolist(), root_l.tolist()
    if not same:
        nodes, links, roots = nodes + node_r.tolist(), links + (own.T @ copies_l).astype(np.int64).tolist(), roots + root_r.tolist()
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], ["node", "links", "root"])


def near_duplicates(vectors: DataFrame, ws: Workspace) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = ws.save("vectors", v.mapInArrow(_vectors, "vec_id long, d1 long, d2 long, dim int, raw binary"))
    one = v.where("raw is not null and vec_id is not null").groupBy("d1", "d2", "vec_id").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    classes = ws.save("classes", one.groupBy("d1", "d2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw")))
    forest = grow(classes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = leaves_of(forest, b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], ["node", "copies", "dim", "raw", "leaves"])

    routed = classes.select("node", "copies", "dim", "raw").mapInArrow(route, "node long, copies long, dim int, raw binary, leaves array<long>")
    routed = deepen(ws.save("routed", routed), ws)
    placed = routed.select("node", "copies", "raw", "leaves", F.explode("leaves").alias("leaf"))
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = placed.join(sizes, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "leaf",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "node",
        "copies",
        "raw",
        "leaves",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for leaf, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (leaf, i, j) != now:
                    if rows and (out := compare(now[0], rows)) is not None:
                        yield out
                    now, rows = (leaf, i, j), []
                rows.append(tuple(row))
        if rows and (out := compare(now[0], rows)) is not None:
            yield out

    found = placed.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(search, "node long, links long, root long")
    found = ws.save("found", found)
    reached = connected_components(ws, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = classes.select("d1", "d2", "node", "copies").join(links, "node", "left").join(reached, "node", "left")
    of_class = of_class.select("d1", "d2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    out = v.select("vec_id", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.when(named, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: All pairs by cosine, and their components.
ORACLE = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= {THRESHOLD}::DOUBLE * a.norm * b.norm),
both_ways AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS vec_id, a AS root FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.vec_id WHERE r.root < e.b),
least AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.root, e.vec_id)) AS component_id, coalesce(l.root, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN least l ON l.vec_id = e.vec_id
"""
