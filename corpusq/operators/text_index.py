"""Search by regular expression through an index of trigrams.

Two tables below one folder. `rows`: the searched table with a running number `row`, in blocks of BLOCK_ROWS by
partition. `postings`: (gram, word, rows) for each different trigram in the searched columns of a word, that is of up to 64 rows whose
numbers follow each other; `rows` has a bit for each of them that has the trigram. They are ordered by gram and word and
written with delta encoding, so a filter on grams skips the other row groups.

A pattern's literals tell which trigrams a match must have, as a formula of ANDs and ORs. The postings of those few grams are
combined per word before their shuffle, and the formula is evaluated on their bits; what is left are the candidates, 64 to a row, and only
their blocks are read, as the join on the block prunes partitions; the pattern itself then decides. A pattern without a literal of three characters, or one of a
syntax that isn't understood, is searched by a scan: results are the same, the index only saves reading.

Defined results: as `functions.text.matches` has it, in any of the columns, whatever the case; null columns have no match; an empty table
gives an empty result; characters are compared by their single-character case folding.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusq.functions.text import matches
from corpusq.plans.once import free_name
from corpusq.plans.workspace import Workspace, shuffles_removed

BLOCK_ROWS = 1 << 16
#: Candidates are broadcast (a word, at most 1,024 a block) if the table has no more blocks; beyond, they prune blocks only.
MOST_BLOCKS = 1 << 10
#: Rows of formulas: True (no condition), a gram as an integer, ("and", parts) or ("or", parts).
Formula = bool | int | tuple


CASED = 0x20000  # no character from here on has cases


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point below CASED the form that all its cases share, by single characters."""
    out = np.arange(CASED, dtype=np.uint32)
    for i in range(CASED):
        up = chr(i).upper()
        low = (up if len(up) == 1 else chr(i)).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def fold(text: str) -> np.ndarray:
    """The code points of a text, those of all cases alike."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < CASED, _folded()[np.minimum(code, CASED - 1)], code).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """The different trigrams of a folded text, as three code points of 21 bits."""
    code = fold(text)
    return np.unique((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])


def _both(kind: str, parts: list[Formula]) -> Formula:
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _needs(tree) -> Formula:
    """What every match of a parsed pattern must have."""
    parts: list[Formula] = []
    run: list[str] = []

    def close() -> None:
        parts.extend(int(g) for g in grams("".join(run)))
        run.clear()

    def walk(nodes) -> None:
        for op, value in nodes:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(value))
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name == "AT":
                continue
            else:
                close()
                if name == "BRANCH":
                    parts.append(_both("or", [_needs(b) for b in value[1]]))
                elif name.endswith("REPEAT") and value[0] >= 1:
                    parts.append(_needs(value[2]))

    walk(tree)
    close()
    return _both("and", parts)


def required(pattern: str, literal: bool = False) -> Formula:
    """The formula of trigrams for a pattern; True if it must be searched by a scan."""
    if literal:
        return _both("and", [int(g) for g in grams(pattern)])
    if re.search(r"\\[0QEpPRXGhHVvNKk]|&&|\(\?[a-zA-Z-]|\[[^\]]*\[|\\c", pattern):  # another meaning, or none, in the parser used here
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return True
    return _needs(tree)


def _grams_of(formula: Formula) -> set[int]:
    if formula is True:
        return set()
    return {formula} if isinstance(formula, int) else set().union(*map(_grams_of, formula[1]))


def _holds(formula: Formula) -> Column:
    """An aggregate: the bits of the rows of a word whose postings fulfil a formula."""
    if isinstance(formula, int):
        return F.bit_or(F.when(F.col("gram") == formula, F.col("rows")).otherwise(0))
    out = None
    for part in map(_holds, formula[1]):
        out = part if out is None else out.bitwiseAND(part) if formula[0] == "and" else out.bitwiseOR(part)
    return out


def _block_bits() -> int:
    return BLOCK_ROWS.bit_length() - 1


def _word_bits() -> int:
    """Rows of a word, as a power of two: as many as a long has bits, and no more than a block has."""
    return min(6, _block_bits())


def _postings(word_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, word, rows of batches (row, texts); a word that two batches share has a row from each."""
    for b in batches:
        words = np.asarray(b.column(0)) >> word_bits
        edges = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(words)]
        for low, high in zip(edges, edges[1:]):
            found, bits = [], []
            for i in range(low, high):
                texts = (c[i].as_py() for c in b.columns[1:])
                of = [grams(t) for t in texts if t and len(t) > 2]
                if of:
                    found.append(of[0] if len(of) == 1 else np.unique(np.concatenate(of)))
                    bits.append(1 << (b.column(0)[i].as_py() & ((1 << word_bits) - 1)))
            if not found:
                continue
            gram = np.concatenate(found)
            order = np.argsort(gram, kind="stable")
            gram, bit = gram[order], np.repeat(np.array(bits, np.uint64), list(map(len, found)))[order]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            rows = np.bitwise_or.reduceat(bit, first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(np.full(len(first), words[low])), pa.array(rows)], ["gram", "word", "rows"])


def build(df: DataFrame, path: str, columns: Sequence[str]) -> TextIndex:
    """Write the index of a table for searches in some of its string columns."""
    spark = df.sparkSession
    row, block = "row", "block"
    if clash := {row, block} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns of the index's names: {', '.join(sorted(clash))}")
    numbered = df.withColumn(row, F.monotonically_increasing_id()).withColumn(block, F.shiftright(F.col(row), _block_bits()))
    numbered.write.mode("overwrite").option("compression", "zstd").partitionBy(block).parquet(f"{path}/rows")
    rows = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    ws, bits = Workspace(spark, "postings"), _word_bits()
    # saved, as the bounds of the ranges are sampled in a pass of its own
    posts = ws.save("unordered", rows.select(row, *columns).mapInArrow(partial(_postings, bits), "gram long, word long, rows long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posts = posts.repartitionByRange(parts, "gram", "word").sortWithinPartitions("gram", "word")
    with shuffles_removed(spark):
        posts.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/postings")
    ws.clear()
    return TextIndex(spark, path, columns, numbered.schema)


class TextIndex:
    """An index that `build` wrote; schema: of its rows, read from the files if not given."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], schema: StructType | None = None) -> None:
        self.rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/rows")
        self.postings = spark.read.schema("gram long, word long, rows long").parquet(f"{path}/postings")
        self.columns = list(columns)
        self.blocks = len({f.rsplit("/", 2)[-2] for f in self.rows.inputFiles()})

    def candidates(self, formula: Formula) -> DataFrame:
        """block, word, rows: the words with rows that fulfil a formula, and these rows' bits."""
        some = self.postings.where(F.col("gram").isin(sorted(_grams_of(formula))))
        found = some.groupBy("word").agg(_holds(formula).alias("rows")).where("rows <> 0")
        return found.select(F.shiftright("word", _block_bits() - _word_bits()).cast(self.rows.schema["block"].dataType).alias("block"), "word", "rows")

    def search(self, pattern: str, literal: bool = False) -> DataFrame:
        """The table's rows with a match in one of the columns; see `functions.text.matches`."""
        formula, rows = required(pattern, literal), self.rows
        hit = matches(pattern, *[F.col(f"`{c}`") for c in self.columns], literal=literal)
        if formula is True:
            return rows.where(hit).drop("row", "block")
        found = self.candidates(formula)
        # blocks are few: at most one a BLOCK_ROWS rows, and those of the candidates prune the scan
        rows = rows.join(F.broadcast(found.select("block").distinct()), "block", "left_semi")
        if self.blocks > MOST_BLOCKS:
            return rows.where(hit).drop("row", "block")
        word, bits = free_name(rows, "word"), free_name(rows, "rows_of_word")
        rows = rows.withColumn(word, F.shiftright("row", _word_bits())).join(F.broadcast(found.select(F.col("word").alias(word), F.col("rows").alias(bits))), word)
        candidate = F.getbit(F.col(bits), F.col("row").bitwiseAND((1 << _word_bits()) - 1).cast("int")) == 1
        return rows.where(F.when(candidate, hit)).drop(word, bits, "row", "block")  # one condition: the pattern isn't tried before the join
