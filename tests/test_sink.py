"""The batch sink: nothing twice, nothing half, and delivery with receipts."""

import json
from pathlib import Path

import pytest
from pyspark import TaskContext

from corpusq.sources import sink

SCHEMA = "id long, text string, tags array<string>"


def rows(n):
    return [(i, None if i % 7 == 0 else f"té\nxt {i}", ["a", "b"][: i % 3]) for i in range(n)]


def back(spark, at):
    return sorted(((r.id, r.text, r.tags) for r in sink.read_batches(spark, at, SCHEMA).collect()))


def test_round_trip_and_batches(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    sink.write_batches(spark.createDataFrame(rows(250), SCHEMA).repartition(3), at, 20)
    got = sink.read_batches(spark, at, SCHEMA)
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert back(spark, at) == sorted(rows(250)) and max(sizes) == 20 and sum(s < 20 for s in sizes) <= 3
    sink.write_batches(spark.createDataFrame(rows(5), SCHEMA), at, 20)
    assert len(back(spark, at)) == 255


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    for n in (40, 30):
        sink.write_batches(spark.createDataFrame(rows(n), SCHEMA), at, 7, run="monday")
    assert back(spark, at) == sorted(rows(30))


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    bad = spark.createDataFrame(rows(50), SCHEMA).repartition(4).selectExpr("id", "CASE WHEN id = 33 THEN raise_error('broken') ELSE text END AS text", "tags")
    with pytest.raises(Exception, match="broken"):
        sink.write_batches(bad, at, 5)
    assert back(spark, at) == [] and sink.committed(spark, at) == []
    assert not list(Path(tmp_path, "store").rglob("*.jsonl"))


def test_a_second_attempt_of_a_task_counts_once(spark, tmp_path, monkeypatch):
    """Two attempts of one task have written; the commit names one of them."""
    import pyarrow as pa

    class Task:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            return self.attempt

    at = f"file://{tmp_path}/store"
    writer = sink.BatchWriter({"path": at, "batch_rows": "4"})
    batch = pa.RecordBatch.from_pylist([{"id": i, "text": f"t{i}", "tags": []} for i in range(10)])
    monkeypatch.setattr(TaskContext, "get", lambda: Task(1))
    first = writer.write(iter([batch]))
    monkeypatch.setattr(TaskContext, "get", lambda: Task(2))
    second = writer.write(iter([batch]))
    assert (first.batches, first.rows) == (second.batches, second.rows) == (3, 10) and first.attempt != second.attempt
    writer.commit([second, None])
    monkeypatch.undo()
    assert [r[0] for r in back(spark, at)] == list(range(10))
    assert len({p.name for p in Path(tmp_path, "store/batches").rglob("*.jsonl")}) == 3  # the same keys


def test_delivery(spark, tmp_path):
    at, out = f"file://{tmp_path}/store", str(tmp_path / "received")
    sink.write_batches(spark.createDataFrame(rows(30), SCHEMA).repartition(2), at, 4)

    def send(key, records, out=out):
        place = Path(out, key)
        Path(out).mkdir(exist_ok=True)
        tried = Path(out, key + ".tried")
        if not tried.exists():
            tried.touch()
            raise OSError("busy")
        assert not place.exists()  # a key comes once
        place.write_text(json.dumps(records))

    sink.deliver(spark, at, send, pause=0.01)
    sink.deliver(spark, at, send, pause=0.01)
    got = [r["id"] for p in Path(out).iterdir() if not p.name.endswith(".tried") for r in json.loads(p.read_text())]
    assert sorted(got) == list(range(30))
    with pytest.raises(Exception, match="always"):
        sink.write_batches(spark.createDataFrame(rows(3), SCHEMA), at)
        sink.deliver(spark, at, lambda key, records: (_ for _ in ()).throw(OSError("always")), tries=2, pause=0.01)


def test_empty_and_wrong_options(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    sink.write_batches(spark.createDataFrame([], SCHEMA), at)
    assert back(spark, at) == []
    with pytest.raises(Exception, match="batch_rows"):
        sink.write_batches(spark.createDataFrame(rows(3), SCHEMA), at, 0)
