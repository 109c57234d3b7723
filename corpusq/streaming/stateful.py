"""Streams that remember: first-seen texts across micro-batches, and running service statistics.

`keep_first` keeps a small entry per distinct text (its first row's id, and how often the text came) in RocksDB, by a digest;
texts themselves aren't sent to it. The entries of a bucket of digests are one state, as each state costs calls from Python to the
store in every micro-batch that touches it, and these cost more than some thousand entries. With a watermark, rows later than that are
dropped and a text that hasn't come for `forget_ms` of event time is forgotten by a timer; without one, all texts are remembered. What
one task holds is a bucket's entries and its ids of one micro-batch, which the source's rate limit bounds.

`running_stats` is a streaming aggregation, combined before its shuffle, so one busy endpoint is no hot key; `latest` reads
its newest totals. Both go on from their checkpoint after a stop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from corpusq.plans.once import free_name

STORE = "spark.sql.streaming.stateStore.providerClass"
SETTINGS = {
    STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whose memory is bounded for all stores of an executor together."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class FirstSeen(StatefulProcessor):
    """Per text: the first row's id and the number of rows so far. Of the rows of one micro-batch the least id is the first.

    by: the columns of the grouping key, which are left out of the rows.
    forget_ms: how long after a text's last row, in event time, it is forgotten. A bucket's timer is due no later than its first text.
    """

    ENTRIES = StructType([StructField("digests", ArrayType(BinaryType())), StructField("ids", ArrayType(StringType())), StructField("rows", ArrayType(LongType())), StructField("until", ArrayType(LongType())), StructField("timer", LongType())])

    def __init__(self, key: str, time: str | None, forget_ms: int | None = None, by: Sequence[str] = ()) -> None:
        self.key, self.time, self.forget_ms, self.left = key, time, forget_ms, {"text_digest", *by}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", self.ENTRIES)

    def _entries(self, now: int) -> tuple[dict[bytes, tuple[str, int, int]], int]:
        """What isn't due (timers run after a micro-batch's rows), and the bucket's timer (0: none)."""
        if (held := self.seen.get()) is None:
            return {}, 0
        *columns, timer = held
        return {bytes(d): e for d, *e in zip(*columns) if not 0 < e[2] <= now}, timer

    def _store(self, entries: dict[bytes, tuple[str, int, int]], timer: int) -> None:
        if not entries:
            self.seen.clear()
            return
        first = min(e[2] for e in entries.values())
        if first and (not timer or first < timer):
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer := first)
        self.seen.update((list(entries), *map(list, zip(*entries.values())), timer))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        entries, timer = self._entries(timerValues.getCurrentWatermarkInMs())
        texts: dict[bytes, list[Row]] = {}
        for r in rows:
            texts.setdefault(bytes(r["text_digest"]), []).append(r)
        for digest, held in texts.items():
            held.sort(key=lambda r: (r[self.key] is None, r[self.key]))
            known = digest in entries
            first, before, until = entries[digest] if known else (str(held[0][self.key]), 0, 0)
            for i, r in enumerate(held):
                new = {"is_duplicate": known or r[self.key] != held[0][self.key], "first_id": first, "rows_so_far": before + i + 1}
                yield Row(**{n: v for n, v in r.asDict().items() if n not in self.left}, **new)
            if self.forget_ms is not None:
                until = max(until, int(max(r[self.time] for r in held).timestamp() * 1000) + self.forget_ms)
            entries[digest] = first, before + len(held), until
        self._store(entries, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._store(self._entries(timerValues.getCurrentWatermarkInMs())[0], 0)
        return iter([])

    def close(self) -> None:
        pass


def keep_first(rows: DataFrame, key: str = "review_id", *, time: str | None = None, late: str = "10 minutes", forget_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """The columns of a stream but text, with is_duplicate, first_id, rows_so_far.

    The stream has a column text, or text_digest (binary) instead of it. A null text is nothing's duplicate. time: the event time,
    for the watermark `late` and for forget_ms. Rows that share key and text in a micro-batch have one flag. buckets: fixed for a checkpoint;
    a micro-batch reads and writes all entries of those that it touches, so many small micro-batches over many texts want more.
    """
    if forget_ms is not None and time is None:
        raise ValueError("forget_ms needs an event time")
    if "text_digest" not in rows.columns:
        rows = rows.withColumn("text_digest", digest(rows, key)).drop("text")
    out = StructType([f for f in rows.schema if f.name != "text_digest"])
    out = out.add("is_duplicate", "boolean").add("first_id", "string").add("rows_so_far", "long")
    bucket = free_name(rows, "text_bucket")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64("text_digest"), F.lit(buckets)))
    if time is not None:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(bucket).transformWithState(FirstSeen(key, time, forget_ms, [bucket]), out, "Append", "None" if time is None else "EventTime")


def digest(rows: DataFrame, key: str) -> Any:
    """A text's digest; of a null text, one by its key, in a space of its own."""
    own = F.concat(F.lit("\0null "), F.coalesce(F.col(key).cast("string"), F.uuid()))
    return F.when(F.col("text").isNotNull(), F.unhex(F.sha2("text", 256))).otherwise(own.cast("binary"))


def append(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take all there is, in as many triggers as the source's limit asks for, into a Parquet folder; exactly once by the sink's log."""
    with rocks(out.sparkSession):
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_stats(log: DataFrame, path: str, checkpoint: str, by: str = "endpoint") -> StreamingQuery:
    """Totals per endpoint (requests, reviews, latency) after each micro-batch, from a stream (by, n_reviews, latency_ms).

    A micro-batch writes the totals of the endpoints it has touched to `batch=N`; written again after a failure, it replaces itself.
    """
    totals = log.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("n_reviews"), F.lit(0)).alias("reviews"), F.sum("latency_ms").alias("latency_ms"), F.count("latency_ms").alias("timed"))

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocks(log.sparkSession):
        return totals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, by: str = "endpoint") -> DataFrame:
    """total_requests, total_reviews_scored, average_response_time_ms over all endpoints, by their newest totals."""
    now = spark.read.option("basePath", path).parquet(path).groupBy(by).agg(F.max_by(F.struct("requests", "reviews", "latency_ms", "timed"), "batch").alias("t"))
    mean = F.sum("t.latency_ms") / F.sum("t.timed")
    return now.agg(
        F.coalesce(F.sum("t.requests"), F.lit(0)).alias("total_requests"),
        F.coalesce(F.sum("t.reviews"), F.lit(0)).alias("total_reviews_scored"),
        F.coalesce(F.floor(mean * 100 + 0.5) / 100, F.lit(0.0)).alias("average_response_time_ms"),
    )


def arrivals(df: DataFrame, path: str, order: str, parts: int) -> Iterator[DataFrame]:
    """A stream over a folder to which the rows of df come in `parts` steps by an order; each step is to be taken whole before the next."""
    spark = df.sparkSession
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001)
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = df if low is None else df.where(F.col(order) > low)
        some = some if high is None else some.where(F.col(order) <= high)
        some.write.mode("append").parquet(path)
        yield spark.readStream.schema(df.schema).parquet(path)
