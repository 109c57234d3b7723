"""A sink for record batches as a Python data source: `df.write.format("corpusq_batches").option("path", ...)`.

Each task writes its rows as JSON lines, `batch_rows` to a file, below a folder of its own attempt. The job's commit is one
manifest that names the attempts that count, one line a task, so the driver does a few steps whatever the number of batches;
readers see only what a manifest names. A failed or repeated task thus leaves nothing twice, and an aborted job nothing at all. A batch's
key is its task's number, its place and a digest of its rows: the same for the same rows.

`deliver` sends committed batches on to a service, each with its key: after a batch a receipt is written, so a run that is repeated sends
only what has none; a send that fails is tried again after growing pauses. A service that takes a key once gets every batch exactly once.

Paths are those that pyarrow can open (a shared disk, HDFS, object stores), written as URIs.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "corpusq_batches"
BATCH_ROWS = 100


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(uri)
    return files, path.rstrip("/")


def _put(files: fs.FileSystem, path: str, content: bytes) -> None:
    """The file whole or not at all."""
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, path)


@dataclass
class Written(WriterCommitMessage):
    """What a task's attempt has written."""

    attempt: str
    batches: int
    rows: int


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.run = options["path"], int(options.get("batch_rows", BATCH_ROWS)), options.get("run", uuid.uuid4().hex)
        if self.size < 1:
            raise ValueError("batch_rows must be 1 or more")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        task = TaskContext.get()
        attempt = f"{self.run}/{task.partitionId():05d}-{task.taskAttemptId()}"
        held: list[str] = []
        batches = rows = 0

        def flush() -> None:
            nonlocal batches, rows, held
            content = "".join(x + "\n" for x in held).encode()
            key = f"{task.partitionId():05d}-{batches:07d}-{hashlib.sha256(content).hexdigest()[:16]}"
            _put(files, f"{root}/batches/{attempt}/{key}.jsonl", content)
            batches, rows, held = batches + 1, rows + len(held), []

        for b in (b.slice(i, BATCH_ROWS) for b in iterator for i in range(0, b.num_rows, BATCH_ROWS)):  # few rows as objects at once
            for r in b.to_pylist():
                held.append(json.dumps(r, ensure_ascii=False, default=str))
                if len(held) == self.size:
                    flush()
        if held:
            flush()
        return Written(attempt, batches, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        lines = [json.dumps({"attempt": m.attempt, "batches": m.batches, "rows": m.rows}) for m in messages if m is not None and m.batches]
        _put(files, f"{root}/commits/{self.run}.jsonl", "".join(x + "\n" for x in lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/batches/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/batches/{self.run}")


class BatchSink(DataSource):
    """Options: path; batch_rows (100); run, a name under which a repeated job replaces itself."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if "path" not in self.options:
            raise ValueError("the sink needs a path")
        if overwrite:
            files, root = _open(self.options["path"])
            if files.get_file_info(root).type != fs.FileType.NotFound:
                files.delete_dir_contents(root)
        return BatchWriter(dict(self.options))


def write_batches(df: DataFrame, path: str, batch_rows: int = BATCH_ROWS, run: str | None = None) -> None:
    """Append the rows of df as one committed run; a run of the same name is replaced, whatever it had."""
    df.sparkSession.dataSource.register(BatchSink)
    w = df.write.format(FORMAT).mode("append").option("path", path).option("batch_rows", batch_rows)
    (w.option("run", run) if run else w).save()


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders that count, one a task."""
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".jsonl"):
            with files.open_input_stream(info.path) as f:
                out += [f"{path.rstrip('/')}/batches/{json.loads(x)['attempt']}" for x in f.read().splitlines()]
    return out


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows, with `batch`, the key of the batch that holds them."""
    at = committed(spark, path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("batch")
    if not at:
        return spark.createDataFrame([], f"{schema}, batch string")
    return spark.read.schema(schema).json(at).select("*", name)


def deliver(spark: SparkSession, path: str, send: Callable[[str, list[dict]], None], tries: int = 5, pause: float = 0.5) -> None:
    """Call send(key, records) for every committed batch without a receipt, on the executors."""
    if not (at := committed(spark, path)):
        return
    keys = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(at).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        for b in batches:
            for place in b.column(0).to_pylist():
                key, (_, name) = place.rsplit("/", 1)[1].removesuffix(".jsonl"), _open(place.replace("file:/", "file:///", 1) if place.startswith("file:/") and not place.startswith("file://") else place)
                if files.get_file_info(f"{root}/receipts/{key}").type != fs.FileType.NotFound:
                    continue
                with files.open_input_stream(name) as f:
                    records = [json.loads(x) for x in f.read().splitlines()]
                for i in range(tries):
                    try:
                        send(key, records)
                        break
                    except Exception:
                        if i == tries - 1:
                            raise
                        time.sleep(pause * 2**i)
                _put(files, f"{root}/receipts/{key}", b"")
            yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["path"])

    keys.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
