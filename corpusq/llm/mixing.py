"""Mixing sources to target weights with hierarchical budgets and seeded epochs.

Documents hang in a tree of levels (domain, language, source). A node's budget of tokens is shared
among its children in proportion to their weights; a child can take at most max_epochs times the tokens of its
subtree's leaves that have a positive weight on every level below it. What a child can't take goes to its siblings, again by weight, and leaves the
parent only if all children are full. So a shortage is made up among siblings before ancestors.
For children with weights w and capacities c the share is min(c, rate * w), where rate makes the sum
the budget; it follows in closed form from prefix sums over children ordered by c / w.

A leaf then takes whole epochs, and of the next epoch a prefix: that epoch's documents in the order
of a seeded hash, as long as their running token sum stays within the rest; what its next document is too large for (and
the part of a token in a share) is not passed on. A hot leaf is never
sorted whole: token sums per bucket of the hash range show in which bucket the prefix ends, and only
that bucket (of at most about BUCKET_ROWS rows) is ordered, for a cutoff. The documents themselves are then
compared with their leaf's cutoff and don't move. A leaf of n rows has about the square root of n
buckets, so neither they nor the rows of one grow in proportion to a hot leaf.

Defined results: a null level is a value of its own, `(none)`; a null or empty text has no tokens and
is taken only if its place in the order lies before the cutoff; documents with equal hash and id
(repeated rows, null ids) are taken together or not at all; unnamed children weigh 1; weights of 0 or
less take nothing; a leaf without tokens takes nothing; an empty table gives an empty result; other
columns are ignored by `choose` and kept by `mix`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.plans.workspace import Workspace

BUCKET_ROWS = 20_000
NONE = "(none)"


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Uniform in [0, 2^53), by seed, epoch and document."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), doc_id.cast("string")), F.lit(1 << 53))


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (budget of the parent, w, c) with column share, each parent's children by water-filling."""
    live = children.withColumn("w", F.greatest("w", F.lit(0.0)))
    up = Window.partitionBy(*parent or [F.lit(0)]).orderBy("r", "child")
    all_of = Window.partitionBy(*parent or [F.lit(0)])
    live = live.withColumn("r", F.when((F.col("w") > 0), F.col("c") / F.col("w")).otherwise(F.lit(float("inf"))))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = live.withColumn("rate", F.when(F.sum("w").over(after) > 0, (F.col("budget") - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / F.sum("w").over(after)))
    # the rate of the first child that isn't filled is the parent's rate; without one, all are filled
    live = live.withColumn("rate", F.min(F.when((F.col("w") > 0) & (F.col("r") > F.col("rate")), F.struct("r", "child", "rate"))).over(all_of)["rate"])
    return live.withColumn("share", F.when(F.col("w") <= 0, 0.0).otherwise(F.least("c", F.coalesce(F.col("rate") * F.col("w"), F.col("c"))))).drop("r", "rate")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], budget: float, max_epochs: int) -> DataFrame:
    """leaves (the levels, tokens) with column share: tokens to take of each leaf."""
    levels = list(levels)

    def weight(depth: int) -> Column:
        named = [x for k, v in weights[depth].items() for x in (F.lit(k), F.lit(float(v)))]
        return F.coalesce(F.try_element_at(F.create_map(*named), F.col(levels[depth])), F.lit(1.0)) if named else F.lit(1.0)

    nodes = None
    for depth in range(1, len(levels) + 1):
        path, name = levels[:depth], levels[depth - 1]
        # a node can take what its leaves of positive weight on the whole way down have; the rest is no capacity
        reached = reduce(lambda a, b: a & b, [weight(d) > 0 for d in range(depth, len(levels))], F.lit(True))
        level = leaves.groupBy(*path).agg((F.sum(F.when(reached, F.col("tokens")).otherwise(0)) * max_epochs).cast("double").alias("c"))
        level = level.withColumn("w", weight(depth - 1)).withColumn("child", F.col(name))
        if nodes is None:
            level = level.withColumn("budget", F.lit(float(budget)))
        else:
            level = level.join(nodes, path[:-1])
        nodes = share(level, path[:-1]).select(*path, F.col("share").alias("budget"))
    return leaves.join(nodes.withColumnRenamed("budget", "share"), levels)


def plan(docs: DataFrame, ws: Workspace, levels: Sequence[str], weights: Sequence[Mapping[str, float]], budget: float | None, fraction: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(ids, cuts): ids has doc_id, levels, tokens; cuts has each leaf's whole epochs and its cutoff."""
    ids = ws.save("ids", docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels], count_tokens(F.col("text")).alias("tokens")))
    leaves = ws.save("leaves", ids.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    if budget is None:
        budget = fraction * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    cuts = budgets(leaves, levels, weights, budget, max_epochs).where("tokens > 0")
    cuts = cuts.withColumn("take", F.floor(F.col("share") + 1e-6))
    cuts = cuts.withColumn("epochs", F.floor(F.col("take") / F.col("tokens")).cast("long")).withColumn("rest", F.col("take") - F.col("epochs") * F.col("tokens"))
    cuts = ws.save("cuts", cuts.withColumn("width", F.ceil(F.lit(float(1 << 53)) / F.ceil(F.greatest(F.col("rows") / BUCKET_ROWS, F.sqrt("rows"))))))

    keyed = ids.join(cuts.select(*levels, "epochs", "rest", "width"), levels).where("rest > 0")
    keyed = keyed.withColumn("h", order_key(seed, F.col("epochs"), F.col("doc_id"))).withColumn("bucket", F.floor(F.col("h") / F.col("width")))
    sums = keyed.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("t").over(run))
    edge = sums.where("upto > rest").groupBy(*levels).agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("t"), "bucket").alias("before"))
    inside = keyed.join(edge, [*levels, "bucket"])
    order = Window.partitionBy(*levels, "bucket").orderBy("h", F.col("doc_id").asc_nulls_first())
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    last = inside.groupBy(*levels, "bucket").agg(
        F.max("width").alias("width"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("h", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id")))).alias("cutoff"),
    )
    # without a document of its last bucket in the prefix, a leaf's prefix ends with the bucket before
    floor_h = F.col("bucket") * F.col("width") - 1
    last = last.select(*levels, F.coalesce("cutoff", F.struct(floor_h.alias("h"), F.lit((1 << 63) - 1).alias("id"))).alias("cutoff"))
    return ids, ws.save("cutoffs", cuts.select(*levels, "epochs", "rest").join(last, list(levels), "left"))


def _taken(rows: DataFrame, cuts: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    at = rows.join(cuts, list(levels))
    h = order_key(seed, F.col("epochs"), F.col("doc_id"))
    me = F.struct(h.alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    inside = (F.col("rest") > 0) & F.coalesce(me <= F.col("cutoff"), F.lit(True))
    n = F.col("epochs") + inside.cast("long")
    return at.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("epochs", "rest", "cutoff")


def choose(docs: DataFrame, ws: Workspace, levels: Sequence[str], weights: Sequence[Mapping[str, float]], *, budget: float | None = None, fraction: float = 1.0, max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """doc_id, the levels, tokens, epoch: one row for each time a document is taken."""
    if clash := {"doc_id", "tokens", "epoch"} & set(levels):
        raise ValueError(f"a level can't be named {', '.join(sorted(clash))}")
    own = [f"level_{i}" for i in range(len(levels))]
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(levels, own)])
    ids, cuts = plan(rows, ws, own, weights, budget, fraction, max_epochs, seed)
    return _taken(ids, cuts, own, seed).select("doc_id", *[F.col(n).alias(c) for c, n in zip(levels, own)], "tokens", "epoch")


def mix(docs: DataFrame, ws: Workspace, levels: Mapping[str, Column], weights: Sequence[Mapping[str, float]], *, budget: float | None = None, fraction: float = 1.0, max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """The rows of docs, all their columns, once for each time they are taken. levels: name to expression.

    A row travels as one struct, so its columns meet no other names.
    """
    own = [f"level_{i}" for i in range(len(levels))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", "text", *[F.coalesce(e.cast("string"), F.lit(NONE)).alias(n) for n, e in zip(own, levels.values())])
    _, cuts = plan(rows, ws, own, weights, budget, fraction, max_epochs, seed)
    return _taken(rows.drop("text"), cuts, own, seed).select("row.*")


#: Production weights: four domains, and a language's part of each.
WEIGHTS: list[dict[str, float]] = [{"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}, {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}, {}]


def production_levels() -> dict[str, Column]:
    """domain (the source's number modulo 4), lang, source."""
    number = F.nullif(F.regexp_extract("source", "([0-9]+)$", 1), F.lit(""))
    return {"domain": F.concat(F.lit("d"), F.pmod(number.cast("decimal(38,0)"), F.lit(4)).cast("int").cast("string")), "lang": F.col("lang"), "source": F.col("source")}
