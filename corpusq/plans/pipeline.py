"""Raw rows to scored rows, in the three variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as text_functions
from corpusq.functions.chunk import Counter, text_stats
from corpusq.functions.pii import pii_types
from corpusq.functions.score import STAGED, Variant, with_scores
from corpusq.functions.text import json_list
from corpusq.operators import duplicates
from corpusq.operators.clean import long_enough, readable, stripped
from corpusq.plans.once import free_name, once
from corpusq.plans.workspace import Workspace
from corpusq.schema import SCORED_COLUMNS


@dataclass(frozen=True)
class Tokens:
    """A token counter as a column function and, for the chunk kernel, as a Python function (None: the pattern's own)."""

    column: Callable[[Column], Column] = text_functions.count_tokens
    counter: Counter | None = None

    @staticmethod
    def of(counter: Counter) -> Tokens:
        """From a Python function alone; the column form counts batch by batch."""

        @F.pandas_udf("int")
        def column(texts):
            return texts.map(lambda t: None if t is None else counter(t))

        return Tokens(column, counter)


PATTERN = Tokens()


def measured(raw: DataFrame, v: Variant, tokens: Tokens = PATTERN) -> DataFrame:
    """The rows of `clean` with chunk statistics; a text is laid out once for its tokens and its chunks."""
    df = readable(raw, v)
    q = free_name(df, "text_statistics")
    df = once(df, **{q: text_stats(F.col("text"), counter=tokens.counter)})
    df = long_enough(df.withColumn("token_count", F.col(q)["token_count"]), v)
    return df.select("*", f"{q}.chunk_count", f"{q}.avg_chunk_tokens", f"{q}.min_chunk_tokens", f"{q}.max_chunk_tokens", F.col(f"{q}.quality_flag").alias("chunk_quality_flag")).drop(q)


def features(raw: DataFrame, v: Variant, ws: Workspace | None = None, tokens: Tokens = PATTERN) -> DataFrame:
    """Cleaned rows with chunk statistics, duplicates and personal data; all but duplicates row by row.

    All steps of cleaning decide by the text alone, so equal texts are counted before those steps: what is costly runs once a row.
    """
    df = measured(raw, v, tokens)
    found = free_name(df, "found_types")
    df = once(df, **{found: pii_types(F.col("text"))})
    df = df.withColumns({"has_pii": F.size(found) > 0, "pii_types": json_list(F.col(found))}).drop(found)
    if v.duplicates in ("lsh", "jaccard"):
        ws = ws or Workspace(df.sparkSession, "features")
        df = ws.save("features", df)  # read twice, for the keys and with the clusters
        return duplicates.lsh(df, ws) if v.duplicates == "lsh" else duplicates.verified(df, ws)
    if v.duplicates == "members":
        return duplicates.members(df, texts=stripped(raw, v))
    if v.duplicates == "keep_first":
        return duplicates.keep_first(df, texts=stripped(raw, v))
    if v.duplicates == "none":
        return df.withColumns({"is_duplicate": F.lit(False), "duplicate_cluster_id": F.lit(-1).cast("long")})
    raise ValueError(f"unknown kind of duplicates: {v.duplicates}")


def scored(raw: DataFrame, v: Variant = STAGED, ws: Workspace | None = None, tokens: Tokens = PATTERN) -> DataFrame:
    """The 25 columns of the scored layer; the CLI variant keeps all columns and rows of its least score."""
    df = with_scores(features(raw, v, ws, tokens), v)
    if v.min_score is not None:
        return df.where(F.col("index_readiness_score") >= v.min_score)
    return df.select(*SCORED_COLUMNS)


def score_rows(rows: DataFrame, v: Variant, keep: Sequence[str] = ()) -> DataFrame:
    """One response per valid request, without duplicates or timing: the service's row scorer. keep: columns that pass through."""
    df = with_scores(features(rows, v), v)
    metadata = F.struct("stars", F.length("text").alias("text_length"), "chunk_count").alias("metadata")
    return df.select(*keep, "review_id", "chunk_quality_flag", "chunk_score", "chunk_count", "avg_chunk_tokens", "has_pii", "pii_types", "pii_score", "duplicate_score", "index_readiness_score", "recommendation", metadata)
