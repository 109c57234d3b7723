"""The corpus pipeline: documents through five stages, each over all that its predecessor kept.

Every stage works on whole texts and all rows; its docstring states what happens to nulls, empty and repeated rows.
All but the last keep every column of documents, and any other column whatever its name, as they are (line_dedup changes
text and n_chars). An empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusq.llm import bpe, linededup, minhash, mixing, quality
from corpusq.plans.workspace import Workspace, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the rules. A null, empty or blank text has too few words and goes; repeated rows are judged each by itself, ids don't matter."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines of recurring templates but their earliest; ties go by doc_id and position, a null doc_id is the earliest.

    Rows that share a doc_id count as one document. A null or empty text stays as it is; a row that loses its last line goes.
    """
    return linededup.drop_lines(docs, Workspace(spark, "lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id.

    Of the rows with one id and one set of shingles, one stays. A row without an id stays unless its text is a near copy of
    another row's, with an id or without; rows without words stay.
    """
    return minhash.keep_first(docs, Workspace(spark, "near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Seeded prefixes of the leaves of the domain-language-source tree, with nine tenths of all words.

    A null language or source is a value of its own; rows with equal id (repeated ones, those without an id) are taken together or
    not at all; a text without words costs nothing and is taken if it comes before its leaf's cutoff.
    """
    return mixing.mix(docs, Workspace(spark, "mix"), mixing.production_levels(), mixing.WEIGHTS, fraction=0.9, max_epochs=1, seed=17)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text is empty, repeated rows have a row each."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_coding", bpe_coding),
]

#: MinHash components, seeded prefixes and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next, and its own tables and its input then go."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch():
            docs = ws.save(name, stage(spark, docs, sf_dir))
        if i:
            ws.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
