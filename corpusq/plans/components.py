"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and an equi-join on the edge list (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): O(log^2 n) rounds, nothing on the driver but a count
and a checksum a round, and each round is cut by a written table. A hub's minimum is aggregated
before the shuffle; its join is one that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.plans.once import spread
from corpusq.plans.workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes with an edge.

    edges: columns a, b of one orderable type, any direction, repeats allowed. Self-loops and
    edges with a null end are ignored. An empty input gives an empty result.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = ws.save(f"{label}-0", e)
    last, i = None, 0
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last or now[0] == 0:
            break
        last, i = tuple(now), i + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(spread(least), "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.withColumnRenamed("m", "v"))
            .distinct()
        )
        e = ws.save(f"{label}-{i}", small)
        if i > 1:
            ws.drop(f"{label}-{i - 2}")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
