"""The registered queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import bpe, chat, chunks, forest, importance, linededup, minhash, mixing, personal, quality, spelling, suffix, warc
from corpusq.plans.once import widen
from corpusq.plans.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"), Workspace(spark, "op1"))


def op1_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the lines of fewer than MIN_TOKENS tokens, which op1_line_dedup and its SQL leave alone."""
    return linededup.report(_table(spark, sf_dir, "documents"), Workspace(spark, "op1all"), min_tokens=1)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(turns.unionByName(probe))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", *[e.alias(n) for n, e in mixing.production_levels().items()])
    return mixing.choose(docs, Workspace(spark, "op3"), ["domain", "lang", "source"], mixing.WEIGHTS, max_epochs=2, seed=17)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(widen(_table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), Workspace(spark, "op6"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), Workspace(spark, "op7"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(widen(_table(spark, sf_dir, "documents")))


def op9_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup(_table(spark, sf_dir, "documents"), Workspace(spark, "op9"))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "embeddings"), Workspace(spark, "op10"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(widen(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), Workspace(spark, "op11"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(widen(_table(spark, sf_dir, "documents")), Workspace(spark, "op12"), damage=spelling.DAMAGE)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(widen(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op1_line_dedup_all": op1_line_dedup_all,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_minhash": op6_minhash,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_content_chunks": op9_content_chunks,
    "op10_projection_forest": op10_projection_forest,
    "op11_importance": op11_importance,
    "op12_spelling": op12_spelling,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": linededup.ORACLE,
    "op1_line_dedup_all": linededup.ORACLE_ALL,
    "op5_suffix_dedup": suffix.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op9_content_chunks": chunks.ORACLE,
    "op10_projection_forest": forest.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_spelling": spelling.oracle(importance.crc_sql),
    "op13_personal_data": personal.ORACLE,
}
