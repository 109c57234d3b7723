"""Reading raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.plans.once import free_name
from corpusq.schema import RAW

MERGERS = 64


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def sample_exact(df: DataFrame, k: int, key: str, seed: int = 42, weight: str | None = None) -> DataFrame:
    """Exactly k rows (or all), repeatable, in one scan: the k least seeded digests, or with a weight column, drawn without replacement by weight.

    A task keeps its own k least rows before anything moves; tasks' rows are merged in MERGERS groups, each again to its k least,
    and only then in one place, so that place gets MERGERS * k rows whatever the number of tasks. Rows of a weight that is null, zero, negative
    or not a number aren't drawn. Of rows with equal keys (repeated ones) any may be taken.
    """
    digest, group, place = (free_name(df, x) for x in ("sample_digest", "sample_group", "sample_place"))
    rows = df.withColumn(digest, F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    if weight is not None:
        w = F.col(weight).cast("double")
        uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        rows = rows.where((w > 0) & ~F.isnan(w)).withColumn(digest, -F.log(uniform) / w)
    rows = rows.withColumn(group, F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
    least = F.row_number().over(Window.partitionBy(group).orderBy(digest, key))
    return rows.withColumn(place, least).where(F.col(place) <= k).orderBy(digest, key).limit(k).drop(digest, group, place)


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """One object a line; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def count_malformed(spark: SparkSession, path: str, schema: str = RAW) -> int:
    df = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    first = next(f.name for f in df.schema if f.name != "_corrupt_record")
    return df.agg(F.count_if(F.col("_corrupt_record").isNotNull()), F.count(first)).first()[0]  # asks for a column of the data too


def read_json(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Lines or one array, told apart by the first character that isn't blank; a missing path raises."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip("﻿ \t").startswith("[")
    return spark.read.schema(schema).option("multiLine", True).json(path) if array else read_jsonl(spark, path, schema)


def read_first(spark: SparkSession, path: str, n: int, schema: str = RAW) -> DataFrame:
    return read_jsonl(spark, path, schema).limit(n)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_function(spark: SparkSession, path: str, view: str) -> DataFrame:
    """Register a Parquet path as a view for SQL."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def fingerprint(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, length, time of change) of all files below a path; says whether an input is still the same."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def documents_as_raw(documents: DataFrame) -> DataFrame:
    """The documents table in the raw schema, with stars, counts and a date derived from doc_id."""
    i = F.col("doc_id")
    return documents.select(
        i.cast("string").alias("review_id"),
        F.col("source").alias("user_id"),
        F.col("lang").alias("business_id"),
        (F.lit(1) + F.pmod(i, F.lit(5))).cast("double").alias("stars"),
        F.pmod(i, F.lit(7)).alias("useful"),
        F.pmod(i, F.lit(3)).alias("funny"),
        F.pmod(i, F.lit(2)).alias("cool"),
        "text",
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(i, F.lit(730)).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("date"),
    )
