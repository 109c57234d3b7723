"""Streams with state: several triggers, stops and restarts, late rows, forgetting."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusq.streaming import stateful

SCHEMA = "review_id string, text string, ts timestamp"
DAY = datetime(2024, 1, 1)


def add(spark, path, rows):
    spark.createDataFrame([(i, t, DAY + timedelta(minutes=m)) for i, t, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **options):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful.append(stateful.keep_first(rows, **options), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.awaitTermination()
    return {r.review_id: (r.is_duplicate, r.first_id, r.rows_so_far) for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_first_seen_goes_on_after_a_stop(spark, tmp_path):
    at = f"{tmp_path}/in"
    add(spark, at, [("b", "same", 0), ("a", "same", 1), ("c", "other", 2), ("n1", None, 2)])
    add(spark, at, [("d", "same", 3), ("e", "new", 4), ("n2", None, 2)])
    first = run(spark, tmp_path)
    assert first == {"a": (False, "a", 1), "b": (True, "a", 2), "c": (False, "c", 1), "d": (True, "a", 3), "e": (False, "e", 1), "n1": (False, "n1", 1), "n2": (False, "n2", 1)}
    add(spark, at, [("0", "same", 5), ("f", "new", 6), ("g", "", 7), ("h", "", 8)])
    assert run(spark, tmp_path) == first | {"0": (True, "a", 4), "f": (True, "e", 2), "g": (False, "g", 1), "h": (True, "g", 2)}
    assert run(spark, tmp_path)["0"] == (True, "a", 4)  # nothing new, nothing twice
    assert spark.read.parquet(f"{tmp_path}/out").count() == 11


def test_late_rows_are_dropped_and_old_texts_forgotten(spark, tmp_path):
    at = f"{tmp_path}/in"
    add(spark, at, [("a", "one", 0), ("b", "two", 50)])
    add(spark, at, [("c", "one", 30), ("d", "far", 80)])
    add(spark, at, [("late", "one", 20), ("e", "far", 81)])  # the watermark is at 70 now; "one" goes at 30 + 60
    add(spark, at, [("f", "far", 200), ("g", "two", 100)])
    add(spark, at, [("h", "two", 201), ("i", "one", 201)])
    got = run(spark, tmp_path, time="ts", late="10 minutes", forget_ms=60 * 60 * 1000)
    assert "late" not in got and got["c"] == (True, "a", 2) and got["e"] == (True, "d", 2) and got["g"] == (True, "b", 2)
    assert got["i"] == (False, "i", 1) and got["h"] == (False, "h", 1)


def test_texts_of_one_bucket_are_forgotten_one_by_one(spark, tmp_path):
    at = f"{tmp_path}/in"
    add(spark, at, [("a", "one", 0), ("b", "two", 50), ("c", "one", 5)])
    add(spark, at, [("d", "far", 80)])
    add(spark, at, [("e", "far", 81), ("f", "new", 130)])  # "one" goes at 5 + 60, "two" at 50 + 60
    add(spark, at, [("g", "far", 132), ("h", "two", 133), ("i", "one", 134)])  # the watermark is at 120 now
    add(spark, at, [("j", "one", 150), ("k", "two", 150), ("l", "far", 150), ("m", "new", 150)])
    got = run(spark, tmp_path, time="ts", late="10 minutes", forget_ms=60 * 60 * 1000, buckets=1)
    want = {"a": (False, "a", 1), "c": (True, "a", 2), "b": (False, "b", 1), "d": (False, "d", 1), "e": (True, "d", 2), "f": (False, "f", 1), "g": (True, "d", 3)}
    want |= {"h": (False, "h", 1), "i": (False, "i", 1), "j": (True, "i", 2), "k": (True, "h", 2), "l": (True, "d", 4), "m": (True, "f", 2)}
    assert got == want


def test_a_bucket_of_texts_takes_one_read_and_one_write():
    class State:
        value, reads, writes = None, 0, 0

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.writes, self.value = self.writes + 1, value

    class Handle:
        getValueState = staticmethod(lambda name, schema: state)  # noqa: N815

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: -1)  # noqa: N815

    state, seen = State(), stateful.FirstSeen("id", None)
    seen.init(Handle())
    rows = [Row(id=i, text_digest=bytearray(b"%d" % (i % 300))) for i in range(400)]
    got = {r.id: (r.is_duplicate, r.first_id, r.rows_so_far) for r in seen.handleInputRows((0,), iter(rows), Times())}
    assert got == {i: (i >= 300, str(i % 300), 1 + i // 300) for i in range(400)} and (state.reads, state.writes) == (1, 1)
    rows = [Row(id=i, text_digest=b"%d" % (i - 100)) for i in range(399, 499)]
    got = {r.id: (r.is_duplicate, r.first_id, r.rows_so_far) for r in seen.handleInputRows((0,), iter(rows), Times())}
    assert got == {399: (True, "299", 2)} | {i: (False, str(i), 1) for i in range(400, 499)} and (state.reads, state.writes) == (2, 2)


def test_wrong_options(spark):
    with pytest.raises(ValueError, match="event time"):
        stateful.keep_first(spark.range(1).withColumn("text", F.lit("x")), "id", forget_ms=1)


def test_running_stats_over_stops(spark, tmp_path):
    schema = "endpoint string, n_reviews long, latency_ms double"
    batches = [[("score", 1, 10.0), ("batch", 5, 20.0)], [("score", 1, 30.0), ("score", None, None)], [("batch", 2, 5.0)]]
    before = spark.conf.get(stateful.STORE, None)

    def add_log(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def totals():
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stateful.running_stats(log, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return tuple(stateful.latest(spark, f"{tmp_path}/out").first())

    add_log(batches[0])
    add_log(batches[1])
    assert totals() == (4, 7, 20.0)
    add_log(batches[2])
    assert totals() == (5, 9, 16.25) and spark.conf.get(stateful.STORE, None) == before


def test_rows_arrive_in_order(spark, tmp_path):
    seen = []
    for rows in stateful.arrivals(spark.range(100), f"{tmp_path}/in", "id", 4):
        assert rows.isStreaming
        seen.append(spark.read.parquet(f"{tmp_path}/in").agg(F.max("id"), F.count("id")).first())
    assert [m + 1 for m, _ in seen] == [n for _, n in seen] and seen[-1][1] == 100 and len(seen) == 4
