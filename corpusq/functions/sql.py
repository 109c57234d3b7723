"""The text functions by name in Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusq.functions import pii
from corpusq.functions.chunk import STATS, chunks_of, quality_of
from corpusq.functions.score import STAGED
from corpusq.functions.text import SENTENCE_BREAK, TOKEN

CHUNKS = "array<struct<text:string,tokens:int,sentences:int,chunk_id:int>>"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """count_tokens, split_sentences, detect_pii, redact_pii, readiness_score as SQL expressions; chunk_text and chunk_quality as Arrow functions."""

    def create(head: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")

    create("count_tokens(t STRING)", "INT", f"CAST(regexp_count(t, {_literal(TOKEN)}) AS INT)")
    create("split_sentences(t STRING)", "ARRAY<STRING>", f"filter(transform(split(t, {_literal(SENTENCE_BREAK)}), x -> regexp_replace(x, {_literal(r'(?U)^\s+|\s+$')}, '')), x -> x <> '')")
    found = ", ".join(f"CASE WHEN t RLIKE {_literal(pii.detection(ps, fold))} THEN '{kind}' END" for kind, ps, fold in (("address", pii.ADDRESS, True), ("email", [pii.EMAIL], False), ("phone", pii.PHONE, False)))
    create("detect_pii(t STRING)", "ARRAY<STRING>", f"CASE WHEN t IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE filter(array({found}), x -> x IS NOT NULL) END")
    body = "t"
    for kind, pattern in pii.REDACT.items():
        body = f"regexp_replace({body}, {_literal('(?i)' + pii.plain(pattern))}, {_literal(pii.REPLACEMENTS['bracket'][kind])})"
    create("redact_pii(t STRING)", "STRING", body)
    create("readiness_score(flag STRING, is_duplicate BOOLEAN, has_pii BOOLEAN)", "DOUBLE", f"(4 * CASE flag WHEN 'optimal' THEN 100 WHEN 'too_short' THEN {STAGED.too_short} ELSE 0 END + CASE WHEN is_duplicate THEN 0 ELSE 300 END + CASE WHEN has_pii THEN 0 ELSE 300 END) / 10.0D")

    @F.pandas_udf(CHUNKS)
    def chunk_text(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "tokens": n, "sentences": s, "chunk_id": i} for i, (t, n, s) in enumerate(chunks_of(x))] for x in texts])

    @F.pandas_udf(STATS)
    def chunk_quality(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([quality_of([n for _, n, _ in chunks_of(x)]) for x in texts], columns=[c.split()[0] for c in STATS.split(", ")])

    spark.udf.register("chunk_text", chunk_text)
    spark.udf.register("chunk_quality", chunk_quality)
