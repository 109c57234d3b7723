"""Intermediate tables in the folder that the whole cluster shares.

A multi-stage operator writes what several later stages read as Parquet below
``spark.checkpoint.dir``. That cuts the lineage, survives the loss of any executor, and is
columnar and compressed, unlike RDD checkpoints.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without a setting."""
    if root := spark.conf.get("spark.checkpoint.dir", ""):
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.mkdtemp(prefix="corpusq-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corpusq"


_open: list[Workspace] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end the tables of all workspaces made inside; what is needed longer must have been written elsewhere."""
    before = set(map(id, _open))
    try:
        yield
    finally:
        for ws in [w for w in _open if id(w) not in before]:
            ws.clear()
            _open.remove(ws)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let what is written inside delete the files of its shuffles when it is done, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """A folder of intermediate tables for one run of one operator; it goes with the interpreter, or with `scratch`."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _open.append(self)
        atexit.register(self.clear)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write df and return the table read back; the plan behind df is not run again, so its shuffles' files go at once."""
        at = f"{self.path}/{name}"
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def has(self, name: str) -> bool:
        """Whether a table was written whole and is still there."""
        fs, at = self._at(f"{name}/_SUCCESS")
        return fs.exists(at)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all; what still reads it must have been written elsewhere."""
        fs, at = self._at(name)
        fs.delete(at, True)

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # the JVM may have gone before the interpreter ends
            pass
