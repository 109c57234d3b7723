"""Importance resampling towards a target distribution over hashed word n-grams, in two Arrow passes.

First pass: each task counts its features (runs of 1 to 3 words, by CRC-32 modulo BUCKETS) with `np.bincount`
into one vector of BUCKETS numbers, and `treeReduce` adds the tasks' vectors up in levels, so the driver
receives the square root of them at most, each of the same size whatever the input. That is done for the corpus
and for the target texts. A bucket's gain follows from both vectors.

Second pass: the gains (BUCKETS integers) are broadcast, and `np.bincount` with weights sums them per document. A seeded
Gumbel number per document turns the largest scores into a draw without replacement in proportion to exp(weight).

The draw is by rank. Narrow rows are dealt out by ranges of the score and written; the ranges' sizes (a row each) give
every range its first rank, and only ranges that begin among the drawn are ordered. Texts never move.

Words are counted portion by portion, so memory is bounded by a portion and the longest single word, not by a text.

Defined results: a null or empty text has no features, weight 0, and isn't drawn (it has fewer than min_words words); a null doc_id
counts as `seed:` in its random number and comes after all others among ties; repeated rows are documents by themselves (with one id and one
text they have one score, and ranks in any order); an empty table gives an empty result, an empty target leaves only the corpus in the
gains; `importance` ignores other columns, `resample` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.batches import pieces, text_bytes
from corpusq.plans.once import free_name
from corpusq.plans.workspace import Workspace

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
PORTION = 1 << 20
#: Small letters, digits and what is not ASCII stay; capitals become small; all else parts words.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def portions(texts: Iterable[bytes], limit: int = PORTION) -> Iterator[tuple[list[bytes], list[int], int]]:
    """(words, their texts' numbers, old) of about `limit` bytes; the first `old` words, two at most, end the portion before."""
    words: list[bytes] = []
    owner: list[int] = []
    size = old = 0
    for i, text in enumerate(texts):
        plain, at = text.translate(PLAIN), 0
        while at < len(plain):
            end = plain.find(b" ", at + limit)
            end = len(plain) if end < 0 else end
            new = plain[at:end].split()
            words += new
            owner += [i] * len(new)
            size, at = size + end - at, end
            if size >= limit:
                yield words, owner, old
                words, owner, size = words[-2:], owner[-2:], 0
                old = len(words)
    if len(words) > old:
        yield words, owner, old


def features(texts: Iterable[bytes], buckets: int = BUCKETS, limit: int = PORTION) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Portion by portion: (text numbers of the words, text numbers of the features, buckets of the features)."""
    for words, owner, old in portions(texts, limit):
        of, spaced = np.array(owner), [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, islice(spaced, 1, None), one))
        three = list(map(crc32, islice(spaced, 2, None), two))
        fresh = [slice(max(old - n, 0), None) for n in range(3)]  # a feature is new if its last word is
        ends = [of[n:][fresh[n]] for n in range(3)]
        whole = [of[: max(len(of) - n, 0)][fresh[n]] == ends[n] for n in range(3)]
        codes = [np.array(x, np.int64)[fresh[n]][whole[n]] % buckets for n, x in enumerate((one, two, three))]
        yield of[old:], np.concatenate([e[w] for e, w in zip(ends, whole)]), np.concatenate(codes)


def count_buckets(texts: DataFrame, buckets: int = BUCKETS, depth: int = 2) -> np.ndarray:
    """How many features of the texts (column text) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, 0):
            for _, _, code in features(text_bytes(b.column(0)), buckets):
                total += np.bincount(code, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select("text").mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    return vectors.treeReduce(np.add, depth) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares), in doubles, for each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """A Gumbel number in thousandths, by seed and document."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        for b in pieces(batches, 1):
            n = b.num_rows
            words, found, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for of_words, of, code in features(text_bytes(b.column(1)), len(by)):
                words += np.bincount(of_words, minlength=n)
                found += np.bincount(of, minlength=n)
                weight += np.bincount(of, by[code], minlength=n)  # sums of integers, exact in doubles below 2^53
            weight = weight.astype(np.int64)
            score = weight + np.fromiter((noise(x, seed) for x in b.column(0).to_pylist()), np.int64, n)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, found, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, ws: Workspace, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """rows (doc_id, n_words, score, others) with rank: 1, 2, 3... of the drawn, null for the rest.

    Of the N rows with at least min_words words, floor(percent * N / 100) of the largest scores are drawn, ties to the smaller doc_id.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = F.col("n_words") >= min_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = ws.save("dealt", rows.where(enough).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # at most one row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select("part", before.alias("before"), F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100).alias("drawn"))
    at = dealt.join(F.broadcast(ranges), "part")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    among = at.where("before < drawn").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long"))
    behind = at.where("before >= drawn").withColumn("rank", F.lit(None).cast("long"))
    short = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return short.unionByName(among.select(short.columns)).unionByName(behind.select(short.columns))


def importance(docs: DataFrame, target: DataFrame, ws: Workspace, *, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; target has the texts to resemble."""
    gain = gains(count_buckets(docs, buckets), count_buckets(target, buckets))
    return ranked(ws.save("scored", scored(docs, gain, seed)), ws, percent, min_words)


def resample(docs: DataFrame, target: DataFrame, ws: Workspace, **options: int) -> DataFrame:
    """The rows of docs that are drawn, all their columns; rows that share a doc_id with a drawn one (null ids too) come with it."""
    name = free_name(docs, "drawn_id")
    drawn = importance(docs, target, ws, **options).where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def crc_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a string's UTF-8 bytes."""
    table = ", ".join(str(_step(i)) for i in range(256))
    code = f"hex(encode({text}))"
    values = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST((strpos('0123456789ABCDEF', {code}[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', {code}[2 * i]) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), lambda c, b: xor(c >> 8, CAST([{table}][xor(c, b) % 256 + 1] AS BIGINT))), 4294967295)"


def _step(i: int) -> int:
    """What a byte adds to the reversed CRC-32."""
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


ORACLE = rf"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM texts),
f AS (SELECT side, id, array_to_string(l[i:i + n - 1], ' ') AS feature FROM w, unnest(range(1, len(l) + 1)) AS u(i), unnest([1, 2, 3]) AS v(n) WHERE i + n - 1 <= len(l)),
c AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, {crc_sql('feature')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM c)),
x AS (SELECT side, id, bucket, sum(n) AS n FROM c JOIN b USING (feature) GROUP BY ALL),
g AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM x GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS gain FROM g),
sums AS (SELECT id, sum(x.n) AS n, sum(x.n * gain) AS weight FROM x JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
s AS (SELECT w.id AS doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN sums ON w.id = sums.id WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor({PERCENT} * count(*) OVER () / 100) AS drawn FROM s WHERE n_words >= {MIN_WORDS})
SELECT s.*, CASE WHEN rank <= drawn THEN CAST(rank AS BIGINT) END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
