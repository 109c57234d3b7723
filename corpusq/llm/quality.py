"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

A text's words are hashed once; one array of rolling hashes is extended from n to n + 1 words by
a multiplication and a shifted addition, and a sort finds the n-grams that occur twice or more. All
characters of the words inside such n-grams count as repeated, the first occurrence included.
Work is row-local: there is no shuffle, and memory is bounded by one text.

Defined results: a null or empty text has zeros everywhere and fails the base rule (fewer than 20
words); repeated rows are judged each by itself; an empty table gives an empty result; other
columns are ignored by `measure` and kept by `keep_good`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusq.llm.batches import pieces, text_bytes

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Thresholds. ngram_limits: n to the largest share of word characters inside repeated n-grams."""

    min_words: int = 20
    base_window: int = 8
    base_percent: int = 30
    ngram_limits: tuple[tuple[int, float], ...] = ((5, 0.30), (8, 0.25), (10, 0.20))
    line_limit: float = 0.25


def repeated_words(hashes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n: a flag per word, set if the word lies in an n-word window found twice or more."""
    total, out, rolled = len(hashes), {}, hashes
    none = np.zeros(total, bool)
    for n in range(1, max(lengths) + 1):
        if n > 1 and total >= n:
            rolled = rolled[: total - n + 1] * FACTOR + hashes[n - 1 :]
        if n not in lengths:
            continue
        out[n] = none
        if total <= n:
            continue
        order = rolled.argsort()
        same = rolled[order[1:]] == rolled[order[:-1]]
        if not same.any():  # then no longer window is repeated either
            return {k: out.get(k, none) for k in lengths}
        starts = np.zeros(total + 1, np.int64)
        hit = np.zeros(len(rolled), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        starts[: len(hit)] += hit
        starts[n : n + len(hit)] -= hit
        out[n] = starts.cumsum()[:total] > 0
    return out


def judge(text: bytes, rules: Rules = Rules()) -> tuple:
    """The values of `fields` for a text."""
    words = text.split()
    lengths = np.fromiter(map(len, text.translate(None, CONTINUATION).split()), np.int64, len(words))
    chars = int(lengths.sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    distinct = len(set(lines))
    sizes = sorted({rules.base_window, *(n for n, _ in rules.ngram_limits)})
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    flags = repeated_words(hashes, sizes) if len(words) else {n: np.zeros(0, bool) for n in sizes}
    repeat = int(flags[rules.base_window].sum())
    covered = [int(lengths[flags[n]].sum()) for n, _ in rules.ngram_limits]
    again = sum((n - 1) * len(x.translate(None, CONTINUATION + SPACE)) for x, n in Counter(lines).items() if n > 1) if distinct < len(lines) else 0
    failed = len(words) < rules.min_words or 100 * repeat > rules.base_percent * len(words)
    kept = not failed and again <= rules.line_limit * chars and all(c <= limit * chars for c, (_, limit) in zip(covered, rules.ngram_limits))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - distinct, repeat, failed, bool(kept), again, *covered


KEPT = 6


def fields(rules: Rules = Rules()) -> pa.Schema:
    """What `measure` says about a text: the last ones are the characters in lines equal to an earlier one, and those inside repeated n-grams."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    covered = ["repeated_line_chars", *(f"repeated_{n}gram_chars" for n, _ in rules.ngram_limits)]
    return pa.schema([(c, pa.int64()) for c in counts] + [("base_failed", pa.bool_()), ("kept", pa.bool_())] + [(c, pa.int64()) for c in covered])


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id with the results of `judge` for every row of docs."""
    schema = fields(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(x, rules) for x in text_bytes(b.column(1))]
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *schema.names])

    names = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {names}")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, all their columns, whose text passes the rules."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            yield b.filter(pa.array([judge(x, rules)[KEPT] for x in text_bytes(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _windows(n: int) -> str:
    """CTEs up to r{n}: words and their characters inside n-word windows found twice or more."""
    return f"""g{n} AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM words, unnest(range(1, len(w) - {n - 2})) AS u(i) WHERE len(w) > {n}),
o{n} AS (SELECT doc_id, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c{n} AS (SELECT DISTINCT doc_id, i + k AS p FROM o{n}, unnest(range(0, {n})) AS u(k)),
r{n} AS (SELECT c.doc_id, count(*) AS words, sum(length(x.w[c.p])) AS chars FROM c{n} c JOIN words x ON x.doc_id = c.doc_id GROUP BY c.doc_id)"""


_RULES = Rules()
_SIZES = sorted({_RULES.base_window, *(n for n, _ in _RULES.ngram_limits)})
_LIMITS = " AND ".join(f"coalesce(r{n}.chars, 0) <= {limit}::DOUBLE * word_chars" for n, limit in _RULES.ngram_limits)
#: The results of `measure` with the standing rules.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
{", ".join(map(_windows, _SIZES))},
lines AS (SELECT doc_id, x, count(*) AS n FROM d, unnest(string_split(t, chr(10))) AS u(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY ALL),
l AS (SELECT doc_id, sum(n) - count(*) AS dup, sum((n - 1) * length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS again FROM lines GROUP BY doc_id),
m AS (SELECT words.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(coalesce(l.again, 0) AS BIGINT) AS repeated_line_chars, {", ".join(f"CAST(coalesce(r{n}.chars, 0) AS BIGINT) AS repeated_{n}gram_chars" for n, _ in _RULES.ngram_limits)},
  CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(r{_RULES.base_window}.words, 0) AS n_repeat_words,
  {_LIMITS} AND coalesce(l.again, 0) <= {_RULES.line_limit}::DOUBLE * word_chars AS fine
  FROM words {" ".join(f"LEFT JOIN r{n} ON r{n}.doc_id = words.doc_id" for n in _SIZES)} LEFT JOIN l ON l.doc_id = words.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept, repeated_line_chars, {", ".join(f"repeated_{n}gram_chars" for n, _ in _RULES.ngram_limits)}
FROM (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.base_percent} * n_words AS base_failed FROM m)
"""
