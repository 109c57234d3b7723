"""Anomalous periods of a metric: z-score, interquartile fences, moving average.

The table is reduced to one row per period first; everything after that runs on the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = 1.5
SPAN = 3


def by_period(df: DataFrame, metric: str, period: Column) -> DataFrame:
    """period, metric_mean, metric_std (sample), review_count (rows with a metric); rows without a period are left out."""
    rows = df.select(period.alias("period"), F.col(metric).cast("double").alias("m")).where("period is not null")
    return rows.groupBy("period").agg(F.avg("m").alias("metric_mean"), F.stddev_samp("m").alias("metric_std"), F.count("m").alias("review_count"))


def _typed(df: DataFrame, low: Column, high: Column) -> DataFrame:
    low, high = F.coalesce(low, F.lit(False)), F.coalesce(high, F.lit(False))
    return df.withColumns({"is_anomaly": low | high, "anomaly_type": F.when(low, "low").when(high, "high").otherwise("normal")})


def detect(periods: DataFrame, method: str = "zscore", threshold: float = 2.0) -> DataFrame:
    """periods with is_anomaly, anomaly_severity, anomaly_type and the method's own columns."""
    m = F.col("metric_mean")
    if method == "zscore":
        one = periods.agg(F.avg("metric_mean").alias("_mean"), F.stddev_samp("metric_mean").alias("_std"))
        df = periods.join(F.broadcast(one))  # one row
        df = df.withColumn("zscore", F.when(F.col("_std") > 0, (m - F.col("_mean")) / F.col("_std")).otherwise(0.0)).drop("_mean", "_std")
        return _typed(df.withColumn("anomaly_severity", F.abs("zscore")), F.col("zscore") < -threshold, F.col("zscore") > threshold)
    if method == "iqr":
        one = periods.agg(F.percentile("metric_mean", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
        df = periods.join(F.broadcast(one))  # one row
        width = F.col("_q")[1] - F.col("_q")[0]
        lo, hi = F.col("_q")[0] - FENCE * width, F.col("_q")[1] + FENCE * width
        beyond = F.greatest(lo - m, m - hi, F.lit(0.0))
        severity = F.when(beyond <= 0, 0.0).when(width == 0, F.lit(float("inf"))).otherwise(F.try_divide(beyond, width))
        return _typed(df.withColumn("anomaly_severity", severity), m < lo, m > hi).drop("_q")
    if method == "moving_avg":
        w = Window.orderBy("period").rowsBetween(-(SPAN - 1), 0)
        df = periods.withColumn("moving_avg", F.when(F.count("metric_mean").over(w) == SPAN, F.avg("metric_mean").over(w)))
        df = df.withColumn("deviation", F.try_divide(m - F.col("moving_avg"), F.col("moving_avg")))
        return _typed(df.withColumn("anomaly_severity", F.abs("deviation")), F.col("deviation") < -threshold / 10, F.col("deviation") > threshold / 10)
    raise ValueError(f"unknown method: {method}")


def summary(found: DataFrame) -> DataFrame:
    """One row: periods, anomalies, their rate in percent and sorted lists of periods."""
    pick = lambda p: F.array_sort(F.collect_list(F.when(p, F.col("period").cast("string"))))
    n, hits = F.count(F.lit(1)), F.count_if("is_anomaly")
    return found.agg(
        n.alias("total_periods"),
        hits.alias("anomaly_count"),
        F.coalesce(F.try_divide(hits * F.lit(100.0), n), F.lit(0.0)).alias("anomaly_rate"),
        pick(F.col("is_anomaly")).alias("anomalous_periods"),
        pick(F.col("anomaly_type") == "low").alias("low_quality_periods"),
        pick(F.col("anomaly_type") == "high").alias("high_quality_periods"),
    )
