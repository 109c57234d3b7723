"""Scoring a stream of requests, and a running log of what was served.

The row features need no state, so the batch plan applies to a stream as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusq.functions.score import API, Variant
from corpusq.operators.clean import validate_batches, validate_requests
from corpusq.plans.pipeline import score_rows


def score_stream(requests: DataFrame, v: Variant = API, keep: Sequence[str] = ()) -> DataFrame:
    """Responses to the valid requests of a (streaming) table with review_id, text, stars. keep: columns that pass through."""
    return score_rows(validate_requests(requests).where("error is null").drop("error"), v, keep)


def rejected_stream(requests: DataFrame) -> DataFrame:
    return validate_requests(requests).where("error is not null").select("review_id", "error")


def serve(requests: DataFrame, out: str, checkpoint: str, v: Variant = API) -> StreamingQuery:
    """Append responses to a Parquet folder, exactly once by the sink's log."""
    return score_stream(requests, v).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_batches(rows: DataFrame, batch: str, v: Variant = API) -> DataFrame:
    """batch, total_reviews, avg_score (one decimal) of every batch without an error; see `validate_batches`."""
    valid = validate_batches(rows, batch).where("error is null").drop("error")
    scores = score_rows(valid, v, keep=[batch])
    return scores.groupBy(batch).agg(F.count(F.lit(1)).alias("total_reviews"), (F.rint(F.avg("index_readiness_score") * 10) / 10).alias("avg_score"))


def service_stats(log: DataFrame) -> DataFrame:
    """One row from a log (endpoint, n_reviews, latency_ms): requests, reviews, mean latency rounded to 2."""
    return log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum("n_reviews"), F.lit(0)).alias("total_reviews_scored"),
        F.coalesce(F.floor(F.avg("latency_ms") * 100 + 0.5) / 100, F.lit(0.0)).alias("average_response_time_ms"),
    )


def stats_per_window(log: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and mean latency per window of event time; late rows are dropped after the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.avg("latency_ms").alias("mean_ms")).select("w.start", "w.end", "requests", "mean_ms")
