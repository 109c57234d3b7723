"""Writing layers, exports and vector-store batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_READY = ["review_id", "text", "stars", "date", "index_readiness_score"]
EXPORT_PII = ["review_id", "text", "pii_types", "index_readiness_score"]
BATCH = 100


def write_layer(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def overwrite_in_place(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a path that df itself reads: write beside it, move the old table aside, the new one in, and then delete.

    The old or the new table exists whole at every moment: at the path, or (after a crash between the two moves) at path + ".old".
    """
    df.write.mode("overwrite").option("compression", "snappy").parquet(path + ".next")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path + tail) for tail in ("", ".next", ".old"))
    fs = at.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"could not rename {path}.next")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def export_ready(scored: DataFrame) -> DataFrame:
    return scored.where("index_ready").select(*EXPORT_READY)


def export_pii(scored: DataFrame) -> DataFrame:
    return scored.where("has_pii").select(*EXPORT_PII)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes inside texts are doubled and line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_hits(hits: DataFrame, path: str) -> None:
    """All rows of a search as CSV, not only those of its view."""
    write_csv(hits, path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_csv` wrote."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def collection_records(scored: DataFrame) -> DataFrame:
    """Index-ready rows as a document collection takes them: ids, documents, metadatas (stars, date, quality_score, chunk_count)."""
    metadata = F.struct("stars", "date", F.col("index_readiness_score").alias("quality_score"), "chunk_count")
    return scored.where("index_ready").select(F.col("review_id").alias("ids"), F.col("text").alias("documents"), metadata.alias("metadatas"))


#: A class of an object store for `class_objects`.
CLASS_SCHEMA = {
    "class": "Review",
    "properties": [
        {"name": "text", "dataType": ["text"]},
        {"name": "review_id", "dataType": ["string"]},
        {"name": "stars", "dataType": ["number"]},
        {"name": "quality_score", "dataType": ["number"]},
        {"name": "has_pii", "dataType": ["boolean"]},
    ],
}


def class_objects(scored: DataFrame) -> DataFrame:
    """Index-ready rows with the properties of CLASS_SCHEMA."""
    values = {"text": F.col("text"), "review_id": F.col("review_id"), "stars": F.col("stars"), "quality_score": F.col("index_readiness_score"), "has_pii": F.col("has_pii")}
    properties = F.struct(*[values[p["name"]].alias(p["name"]) for p in CLASS_SCHEMA["properties"]])
    return scored.where("index_ready").select(F.lit(CLASS_SCHEMA["class"]).alias("class"), properties.alias("properties"))


def vector_batches(scored: DataFrame, size: int = BATCH) -> DataFrame:
    """Index-ready rows as upload records with a batch number per partition: (partition, batch), id, text, metadata.

    Batches are counted within partitions by a running id, so numbering needs no global order.
    """
    n = F.monotonically_increasing_id()
    partition, row = F.shiftright(n, 33), n.bitwiseAND((1 << 33) - 1)
    metadata = F.struct("stars", "date", F.col("index_readiness_score").alias("quality_score"), "chunk_count", "has_pii")
    return scored.where("index_ready").select(partition.alias("partition"), F.floor(row / size).alias("batch"), F.col("review_id").alias("id"), "text", metadata.alias("metadata"))


def upload(batches: DataFrame, send: Callable[[list[dict]], None], size: int = BATCH) -> None:
    """Call `send` with lists of at most `size` records, on the executors."""

    def run(rows) -> None:
        held: list[dict] = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    batches.select("id", "text", "metadata").foreachPartition(run)


def check_layer(df: DataFrame, required: Sequence[str], not_null: Sequence[str] = (), least: dict[str, float] | None = None, rows: int | None = None) -> DataFrame:
    """One row per rule with its result, all from one pass."""
    missing = [c for c in required if c not in df.columns]
    aggregates = [F.count(F.lit(1)).alias("rows")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null if c in df.columns]
    aggregates += [F.min(c).cast("double").alias(f"min_{c}") for c in (least or {}) if c in df.columns]
    got = df.agg(*aggregates).first()
    rules = [("required columns", not missing, ", ".join(missing))]
    if rows is not None:
        rules.append(("rows", got["rows"] == rows, str(got["rows"])))
    rules += [(f"no null {c}", got[f"null_{c}"] == 0, str(got[f"null_{c}"])) for c in not_null if c in df.columns]
    rules += [(f"{c} at least {v:g}", got[f"min_{c}"] is None or got[f"min_{c}"] >= v, str(got[f"min_{c}"])) for c, v in (least or {}).items() if c in df.columns]
    return df.sparkSession.createDataFrame(rules, "rule string, passed boolean, found string")


def assert_layer(df: DataFrame, *args, **kwargs) -> None:
    failed = check_layer(df, *args, **kwargs).where("not passed").collect()
    if failed:
        raise AssertionError("; ".join(f"{r.rule}: {r.found}" for r in failed))
