"""Readiness scores and tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_AT, REVIEW_AT = 70, 50
WEIGHTS = (0.4, 0.3, 0.3)
LABELS = {"index": "Index Ready", "review": "Needs Review", "reject": "Reject"}


@dataclass(frozen=True)
class Variant:
    """How one of the three pipelines differs from the others."""

    name: str
    strip: bool
    ascii_share: float | None
    min_tokens: int
    duplicates: str  # lsh, jaccard, members, keep_first or none
    too_short: int
    unknown: int
    min_score: float | None


STAGED = Variant("staged", True, 0.9, 20, "lsh", 30, 0, None)
CLI = Variant("cli", False, None, 20, "keep_first", 50, 50, 70)
API = Variant("api", True, None, 0, "none", 50, 50, None)


def chunk_score(flag: Column, v: Variant) -> Column:
    return F.when(flag == "optimal", 100).when(flag == "too_short", v.too_short).when(flag.isin("too_long", "empty"), 0).otherwise(v.unknown)


def clear_score(bad: Column) -> Column:
    """100 unless the flag is set."""
    return F.when(F.coalesce(bad, F.lit(False)), 0).otherwise(100)


def readiness(chunk: Column, duplicate: Column, pii: Column) -> Column:
    a, b, c = WEIGHTS
    return F.rint((chunk * F.lit(a) + duplicate * F.lit(b) + pii * F.lit(c)) * 10) / 10


def recommendation(score: Column) -> Column:
    return F.when(score >= INDEX_AT, "index").when(score >= REVIEW_AT, "review").otherwise("reject")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "index", 1).when(tier == "review", 2).otherwise(3)


def tier_label(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[tier]


def with_scores(df, v: Variant):
    """df (chunk_quality_flag, is_duplicate, has_pii) with the six score columns."""
    df = df.withColumns({"chunk_score": chunk_score(F.col("chunk_quality_flag"), v), "duplicate_score": clear_score(F.col("is_duplicate")), "pii_score": clear_score(F.col("has_pii"))})
    df = df.withColumn("index_readiness_score", readiness(F.col("chunk_score"), F.col("duplicate_score"), F.col("pii_score")))
    return df.withColumns({"index_ready": F.col("index_readiness_score") >= INDEX_AT, "recommendation": recommendation(F.col("index_readiness_score"))})
