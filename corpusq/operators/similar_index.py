"""A MinHash index that takes documents batch by batch and answers queries, without reading old texts again.

Tables below one folder, to which each batch appends (`batch=N`); a batch counts once its commit is written, and a batch
that failed is written anew under its number:

* rows: id, node of every row; equal texts are one node.
* digests: digest, node of every text.
* posts: key, node of every band, partitioned by band and ordered by key within files, so that a small batch
  skips most row groups.
* sets: node, n, elements, sketch, the full trigram sets for verification and their parities (`linkage.sketch`).
* parents: node, parent of every node that isn't the first of its component. Components are only ever merged, and
  by their roots: a batch adds a row per new member and one per old root that has a new root, and touches nothing else.
  A node's root is found by following parents, at most as many as there were batches.

An insertion joins the batch's keys with the posts. In each touched bucket the new members are compared with
its centre first (a star), so groups of copies become one component; then, in buckets with several components, blocks of new
members meet blocks of all others. Pairs of old members were compared when they came and never meet again.

Defined results: rows without an id or text are left out; texts of fewer than 3 characters have no near ones, only equal ones; a
repeated row changes nothing; an empty batch adds none; ids are compared as strings; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.duplicates import THRESHOLD, VERIFIED_BANDS, VERIFIED_ROWS, band_keys, trigrams
from corpusq.plans import linkage
from corpusq.plans.components import connected_components
from corpusq.plans.linkage import block_parts, chances, compared, places, sketched, sliced
from corpusq.plans.once import spread
from corpusq.plans.workspace import Workspace, shuffles_removed

SCHEMAS = {
    "rows": "id string, node long, batch int",
    "digests": "digest binary, node long, batch int",
    "posts": "key long, node long, batch int, band int",
    "sets": "node long, n long, elements binary, sketch binary, batch int",
    "parents": "node long, parent long, batch int",
}
#: A node's number: its batch, above 50 bits of a running number.
BATCH_BITS = 50
#: Where the numbers of texts begin that are asked for and not in the index.
QUERIES = 1 << 62


def _sets(texts: DataFrame) -> DataFrame:
    """node, n, elements, sketch of node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(trigrams(t)) for t in b.column(1).to_pylist()]
            yield sketched(b.column(0), sets)

    return texts.where(F.length(F.lower("text")) >= 3).select("node", "text").mapInArrow(run, linkage.SKETCHED)


class SimilarIndex:
    """An index in a folder that the whole cluster shares; opened again, it goes on after its last committed batch."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD, bands: int = VERIFIED_BANDS, rows: int = VERIFIED_ROWS) -> None:
        self.spark, self.path, self.percent, self.bands, self.in_band = spark, path.rstrip("/"), round(100 * threshold), bands, rows
        self.batches = 0
        while self._there(f"commits/batch={self.batches}/_SUCCESS"):
            self.batches += 1

    def _there(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table."""
        if not self.batches:
            return self.spark.createDataFrame([], SCHEMAS[name]).drop("batch")
        at = [f"{self.path}/{name}/batch={i}" for i in range(self.batches)]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*at).drop("batch")

    def _append(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        at = f"{self.path}/{name}/batch={self.batches}"
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _posts(self, texts: DataFrame) -> DataFrame:
        """band, key, node of node, text."""
        keyed = band_keys(texts, "node", self.bands, self.in_band)
        return keyed.select(F.posexplode("bands").alias("band", "key"), F.col("id").cast("long").alias("node"))

    def roots(self, nodes: DataFrame, ws: Workspace, label: str) -> DataFrame:
        """node, root of the given nodes: parents followed as far as they lead."""
        parents = self.table("parents")
        now = ws.save(f"{label}-0", nodes.select("node", F.col("node").alias("root")))
        i = 0
        while True:
            up = parents.select(F.col("node").alias("root"), "parent")
            step = now.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("moved"))
            step = ws.save(f"{label}-{i + 1}", step)
            ws.drop(f"{label}-{i}")
            now, i = step.select("node", "root"), i + 1
            if step.where("moved").isEmpty():
                return now

    def _links(self, ws: Workspace, posts: DataFrame, sets: DataFrame, among: bool) -> tuple[DataFrame, DataFrame]:
        """(a, b of confirmed links of new nodes, node, root of the old nodes they share buckets with); `among`: new ones with each other too.

        posts: key, node of the new nodes. Of a node's links with one component the first comes out.
        """
        touched = posts.select("key").distinct()
        old = self.table("posts").select("key", "node").join(touched, "key", "left_semi")
        met = ws.save("met", posts.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False))))
        several = met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
        met = ws.save("shared", met.join(several, "key", "left_semi"))  # few buckets have two members
        ws.drop("met")
        roots = ws.save("touched-roots", self.roots(met.where("not fresh").select("node").distinct(), ws, "root"))
        all_sets = sets.select("node", "n", "elements", "sketch").unionByName(self.table("sets"))
        sizes = all_sets.select("node", "n").join(met.select("node").distinct(), "node", "left_semi")
        members = met.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
        members = ws.save("buckets", members.join(sizes, "node"))
        ws.drop("shared")

        if among:
            first = ws.save("links-1", self._stars(members, all_sets))
            top = ws.save("found", connected_components(ws, self._between_roots(first, roots), "cc-links").select(F.col("node").alias("component"), F.col("component").alias("top")))
            labelled = members.join(top, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
        else:
            labelled = members
        blocks = labelled.groupBy("key").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            *[F.coalesce(F.greatest(F.ceil(F.sum(F.when(side, F.col("n"))) / linkage.BLOCK), F.ceil(F.count_if(side) / linkage.ROWS)), F.lit(0)).cast("int").alias(name) for name, side in (("new", F.col("fresh")), ("old", ~F.col("fresh")))],
        )
        mixed = blocks.where("low < high").select("key", "new", "old")  # another component means another member
        dealt = ws.save("dealt", places(labelled.join(spread(mixed), "key"), among))
        near = ws.save("near", chances(ws, "chances", dealt, all_sets.join(members.select("node").distinct(), "node", "left_semi"), self.percent))
        for name in ("dealt", "chances"):
            ws.drop(name)
        second = sliced(ws, "links-2", near, all_sets, self.percent, forest=False)
        return first.unionByName(second) if among else second, roots

    def _stars(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b of the confirmed links of each new node with the first of the centres (a bucket's first node) of its buckets."""
        centers = members.groupBy("key").agg(F.min_by(F.struct("node", "component"), "node").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
        rays = members.where("fresh").join(spread(centers), "key").where("node <> c.node")
        rays = rays.groupBy("node").agg(F.min_by("c", "c.node").alias("c"), F.first("n").alias("n"))
        rays = rays.select("node", "n", F.col("c.node").alias("key"), F.col("c.component").alias("component"))
        stars = rays.groupBy("key").agg(block_parts().alias("parts"), F.first("component").alias("component"))
        place = (F.lit(0).alias("j"), F.lit(1).alias("side"), "node", F.col("node").alias("component"))
        rim = rays.drop("component").join(spread(stars.drop("component")), "key").select("key", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("i"), *place)
        hubs = stars.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("key").alias("node"), "component")
        return compared(rim.unionByName(hubs), sets, self.percent)

    @staticmethod
    def _between_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
        """Links with old nodes replaced by their roots."""
        for end in ("a", "b"):
            of = roots.select(F.col("node").alias(end), F.col("root").alias("root_of"))
            links = links.join(of, end, "left").withColumn(end, F.coalesce("root_of", end)).drop("root_of")
        return links.where("a <> b").distinct()

    def _classes(self, df: DataFrame, key: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
        """(digest, id, text of the rows with id and text; digest, node of those known)."""
        rows = df.select(F.col(f"`{key}`").cast("string").alias("id"), "text").where("id is not null and text is not null")
        rows = ws.save("batch", rows.withColumn("digest", F.unhex(F.sha2("text", 256))))
        known = self.table("digests").join(rows.select("digest").distinct(), "digest", "left_semi")
        return rows, ws.save("known", known.select("digest", "node"))

    def insert(self, df: DataFrame, key: str = "review_id") -> None:
        """Add the rows (key, text)."""
        ws = Workspace(self.spark, "insert")
        rows, known = self._classes(df, key, ws)
        new = rows.groupBy("digest").agg(F.min("id").alias("id")).join(known, "digest", "left_anti")
        number = F.lit(self.batches).cast("long") * (1 << BATCH_BITS) + F.monotonically_increasing_id()
        new = ws.save("new", new.withColumn("node", number))
        self._append("digests", new.select("digest", "node"))
        nodes = known.unionByName(new.select("digest", "node"))
        self._append("rows", rows.select("id", "digest").distinct().join(spread(nodes), "digest").select("id", "node"))
        texts = ws.save("texts", rows.join(new, ["digest", "id"]).dropDuplicates(["node"]).select("node", "text"))
        sets = self._append("sets", _sets(texts))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        posts = self._append("posts", self._posts(texts).repartition(parts, F.shiftright("key", 56)).sortWithinPartitions("band", "key"), "band")
        links, roots = self._links(ws, posts.select("key", "node"), sets, among=True)
        found = connected_components(ws, self._between_roots(links, roots), "cc-roots")
        self._append("parents", found.where("node <> component").select("node", F.col("component").alias("parent")))
        self._commit()
        ws.clear()

    def _commit(self) -> None:
        self._append("commits", self.spark.range(1))
        self.batches += 1

    def query(self, df: DataFrame, key: str = "review_id") -> DataFrame:
        """id, cluster, n_clusters of the rows (key, text), which aren't added: the clusters that hold an equal or near text, and the first one's name.

        A cluster is named by the least id in it, as in `clusters`, a text without near ones by its own rows' least id; null and 0 if the index has nothing near.
        """
        ws = Workspace(self.spark, "query")
        rows, known = self._classes(df, key, ws)
        new = ws.save("new", rows.select("digest").distinct().withColumn("node", F.monotonically_increasing_id() + QUERIES))
        unknown = rows.join(known.select("digest"), "digest", "left_anti")  # what is near to a text of the index is in its cluster
        texts = ws.save("texts", unknown.dropDuplicates(["digest"]).join(new, "digest").select("node", "text"))
        links, _ = self._links(ws, ws.save("posts", self._posts(texts).select("key", "node")), ws.save("own-sets", _sets(texts)), among=False)
        ends = [links.select(F.col(a).alias("node"), F.col(b).alias("met")) for a, b in (("a", "b"), ("b", "a"))]
        met = reduce(DataFrame.unionByName, ends).where((F.col("node") >= QUERIES) & (F.col("met") < QUERIES))
        met = met.unionByName(known.withColumnRenamed("node", "met").join(new, "digest").select("node", "met"))
        all_roots = self.roots(met.select(F.col("met").alias("node")).distinct(), ws, "met-roots")
        met = met.join(all_roots.select(F.col("node").alias("met"), "root"), "met").select("node", "root").distinct()
        named = self._names(ws, met.select("root").distinct())
        met = met.join(spread(named), "root").groupBy("node").agg(F.min("name").alias("cluster"), F.count(F.lit(1)).alias("n_clusters"))
        out = rows.select("id", "digest").distinct().join(new, "digest").join(spread(met), "node", "left")
        return out.groupBy("id").agg(F.min("cluster").alias("cluster"), F.coalesce(F.sum("n_clusters"), F.lit(0)).alias("n_clusters"))

    def _labelled(self, ws: Workspace) -> DataFrame:
        """id, node, root of all rows."""
        rows = self.table("rows")
        return ws.save("labelled", rows.join(spread(self.roots(rows.select("node").distinct(), ws, "all")), "node"))

    def _names(self, ws: Workspace, roots: DataFrame) -> DataFrame:
        return self._labelled(ws).join(roots, "root", "left_semi").groupBy("root").agg(F.min("id").alias("name"))

    def clusters(self, ws: Workspace | None = None) -> DataFrame:
        """id, cluster for every row whose text is equal or near to another's; a cluster is named by its least id."""
        ws = ws or Workspace(self.spark, "clusters")
        rows = self._labelled(ws)
        several: Column = (F.count_distinct("node") > 1) | (F.count_distinct("id") > 1)
        named = rows.groupBy("root").agg(F.min("id").alias("cluster"), several.alias("several")).where("several").drop("several")
        return rows.join(spread(named), "root").groupBy("id").agg(F.min("cluster").alias("cluster"))
