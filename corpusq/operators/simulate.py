"""What filtering by readiness would do to retrieval, from four rates of the table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The assumed state without filtering, and how rates change it.
BASELINE = {"retrieval_accuracy": 70.0, "response_time_ms": 850.0, "hallucination_rate": 18.0, "chunk_utilization": 65.0, "user_satisfaction": 3.5}
METRICS = list(BASELINE)
LESS_IS_BETTER = {"response_time_ms", "hallucination_rate"}


def rates(where: Column | None = None) -> list[Column]:
    """avg_score, optimal, dup, pii (percent) over the rows that match, as aggregates."""
    of = lambda c: F.when(where, c) if where is not None else c
    share = lambda p: F.avg(of(p.cast("int"))) * 100
    return [F.avg(of(F.col("index_readiness_score"))).alias("avg_score"), share(F.col("chunk_quality_flag") == "optimal").alias("optimal"), share(F.col("is_duplicate")).alias("dup"), share(F.col("has_pii")).alias("pii")]


def metrics(avg_score: Column, optimal: Column, dup: Column, pii: Column, base: Mapping[str, float] = BASELINE) -> dict[str, Column]:
    points = lambda p, n: F.when(p, float(n)).otherwise(0.0)
    accuracy = F.least(F.lit(base["retrieval_accuracy"]) + points(optimal > 40, 10) + points(dup < 5, 5) + points(pii < 10, 5) + points(avg_score > 80, 10), F.lit(100.0))
    time = F.greatest(F.lit(float(base["response_time_ms"])) - optimal / 100 * 230, F.lit(400.0))
    wrong = F.greatest(F.lit(base["hallucination_rate"]) - (avg_score - 70) / 30 * 6, F.lit(5.0))
    used = F.least(F.lit(base["chunk_utilization"]) + optimal * 0.4, F.lit(100.0))
    joy = F.least(F.lit(base["user_satisfaction"]) + ((accuracy - base["retrieval_accuracy"]) / 100 + (F.lit(base["hallucination_rate"]) - wrong) / 100) * 1.5, F.lit(5.0))
    rounded = lambda c, n: F.rint(c * 10.0**n) / 10.0**n
    some = avg_score.isNotNull()  # an empty table has no metrics
    out = {"retrieval_accuracy": rounded(accuracy, 1), "response_time_ms": F.floor(time).cast("int"), "hallucination_rate": rounded(wrong, 1), "chunk_utilization": rounded(used, 1), "user_satisfaction": rounded(joy, 2)}
    return {k: F.when(some, c) for k, c in out.items()}


def simulate(scored: DataFrame, base: Mapping[str, float] = BASELINE) -> DataFrame:
    """One row with the five metrics."""
    got = metrics(*(F.col(c) for c in ("avg_score", "optimal", "dup", "pii")), base)
    return scored.agg(*rates()).select(*[c.alias(k) for k, c in got.items()])


def compare(scored: DataFrame, threshold: float = 70.0, base: Mapping[str, float] = BASELINE) -> DataFrame:
    """metric, without_filter, with_filter, improvement, pct_improvement: both scenarios from one pass.

    Improvements are positive if filtering helps; percent relate to the unfiltered value.
    """
    names = ("avg_score", "optimal", "dup", "pii")
    kept = [c.alias(f"k_{n}") for c, n in zip(rates(F.col("index_readiness_score") >= threshold), names)]
    one = scored.agg(*rates(), *kept)
    plain = metrics(*(F.col(n) for n in names), base)
    best = metrics(*(F.col(f"k_{n}") for n in names), base)
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), plain[k].cast("double").alias("without_filter"), best[k].cast("double").alias("with_filter"), F.lit(-1.0 if k in LESS_IS_BETTER else 1.0).alias("sign")) for k in METRICS])
    df = one.select(F.explode(rows).alias("r")).select("r.*")
    df = df.withColumn("improvement", F.col("sign") * (F.col("with_filter") - F.col("without_filter")))
    return df.withColumn("pct_improvement", F.try_divide(F.col("improvement"), F.col("without_filter")) * 100).drop("sign")
