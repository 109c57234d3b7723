"""Table functions for Spark SQL: a row per chunk, sentence or found personal datum of a text, with positions.

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks_of(d.text, 500, 1) c
    SELECT * FROM windows_of(TABLE(conversations) PARTITION BY conv_id ORDER BY turn, limit => 500)

Positions count code points, ends are exclusive. A null or blank text has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusq.functions import pii
from corpusq.functions.chunk import PatternLayout, chunks_of


def _schema(*fields: tuple[str, type]) -> StructType:
    return StructType([StructField(n, StringType() if t is str else IntegerType()) for n, t in fields])


def _is_text(arg: AnalyzeArgument, name: str) -> None:
    if arg.isTable or arg.dataType.typeName() not in ("string", "void"):
        raise ValueError(f"{name} takes a string, not {'a table' if arg.isTable else arg.dataType.simpleString()}")


def _at_least(arg: AnalyzeArgument | None, name: str, least: int) -> None:
    if arg is not None and (arg.value is None or arg.value < least):
        raise ValueError(f"{name} must be a constant of {least} or more")


class ChunksOf:
    """chunk_id, text, tokens, sentences of each chunk; limit and overlap must be constants."""

    @staticmethod
    def analyze(text: AnalyzeArgument, limit: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        _is_text(text, "chunks_of")
        _at_least(limit, "limit", 1)
        _at_least(overlap, "overlap", 0)
        return AnalyzeResult(_schema(("chunk_id", int), ("text", str), ("tokens", int), ("sentences", int)))

    def eval(self, text: str | None, limit: int = 500, overlap: int = 1) -> Iterator[tuple]:
        for i, (part, tokens, sentences) in enumerate(chunks_of(text, limit, overlap)):
            yield i, part, tokens, sentences


class SentencesOf:
    """sentence_id, start, end, text, tokens of each sentence."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _is_text(text, "sentences_of")
        return AnalyzeResult(_schema(("sentence_id", int), ("start", int), ("end", int), ("text", str), ("tokens", int)))

    def eval(self, text: str | None) -> Iterator[tuple]:
        at = PatternLayout(text or "")
        if len(at.starts):
            start, end = at.sentences()
            for i, (a, b, n) in enumerate(zip(start.tolist(), end.tolist(), at.tokens(start, end).tolist())):
                yield i, a, b, text[a:b], n


class PersonalDataIn:
    """kind, start, end, found of each match of the redaction patterns, in the order of the kinds and then of places."""

    def __init__(self) -> None:
        self.patterns = {k: regex.compile("(?ai)" + pii.plain(p)) for k, p in pii.REDACT.items()}

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _is_text(text, "personal_data_in")
        return AnalyzeResult(_schema(("kind", str), ("start", int), ("end", int), ("found", str)))

    def eval(self, text: str | None) -> Iterator[tuple]:
        if not text:
            return
        digits = any(c.isdigit() for c in text) if "@" not in text else True
        for kind, p in self.patterns.items():
            if digits if kind in pii.FIRST else "@" in text:
                for m in p.finditer(text):
                    yield kind, m.start(), m.end(), m[0]


class WindowsOf:
    """Rows of a table in windows: window, first, last, tokens, text of runs of rows of one partition, each up to `limit` tokens but of one row at least.

    The table has columns turn and text; it must come with PARTITION BY one column and ORDER BY turn. A row adds its tokens and a line.
    """

    def __init__(self) -> None:
        self.rows: list[str] = []
        self.window, self.used, self.first, self.last = 0, 0, None, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, limit: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("windows_of takes a table")
        _at_least(limit, "limit", 1)
        missing = {"conv_id", "turn", "text"} - set(rows.dataType.fieldNames())
        if missing:
            raise ValueError(f"windows_of misses columns: {', '.join(sorted(missing))}")
        fields = [rows.dataType["conv_id"], StructField("window", IntegerType()), StructField("first", rows.dataType["turn"].dataType), StructField("last", rows.dataType["turn"].dataType), StructField("tokens", IntegerType()), StructField("text", StringType())]
        return AnalyzeResult(StructType(fields), partitionBy=[PartitioningColumn("conv_id")], orderBy=[OrderingColumn("turn")])

    def eval(self, rows: Row, limit: int = 500) -> Iterator[tuple]:
        self.conv_id = rows["conv_id"]
        n = PatternLayout(rows["text"] or "").total()
        if self.rows and self.used + n > limit:
            yield self._closed()
        if not self.rows:
            self.first = rows["turn"]
        self.rows.append(rows["text"] or "")
        self.used, self.last = self.used + n, rows["turn"]

    def _closed(self) -> tuple:
        out = self.conv_id, self.window, self.first, self.last, self.used, "\n".join(self.rows)
        self.rows, self.window, self.used = [], self.window + 1, 0
        return out

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield self._closed()


def register(spark: SparkSession) -> None:
    """chunks_of, sentences_of, personal_data_in and windows_of, by name in SQL."""
    for name, f in (("chunks_of", ChunksOf), ("sentences_of", SentencesOf), ("personal_data_in", PersonalDataIn), ("windows_of", WindowsOf)):
        spark.udtf.register(name, udtf(f))
