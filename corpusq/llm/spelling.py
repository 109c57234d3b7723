"""Grouping of spelling variants by a symmetric-delete join.

Words are counted in the JVM, combined before the shuffle. Every word then emits itself and its distinct
single deletions, and an equi-join on these brings together the words that can be near. A deletion is sent as a
124-bit name (with its length), not as a string, so a word of L characters costs O(L) and not O(L^2): a
name is a sum over characters times powers, of which each deletion is a prefix plus a shifted suffix.

A deletion carries the places where a character of the word was left out (a run of equal characters; leaving
out any of them gives the same string). So the distance is exact without the strings: a word is at distance one
from a deletion of it; two words with the deletion K in common are at distance one if and only if they have a
place in common, where one character is replaced. Each near pair shares just one name, so no pair is found twice.
Words that share a name are K itself and K with one letter put in, at most letters * (length + 1): a
bucket is bounded by the alphabet and not by the input.

A word's number is its place in code-point order, so the near word of largest count with ties resolved is a maximum of
(count, -number), combined before its shuffle. Forms lead to words at least RATIO times as frequent, so chains have no cycles
and at most log_RATIO(count) steps; roots are found by joining the roots of roots until none moves, that is in about five rounds.

All joins are told to merge: Spark sizes the deletions by the file of words that they come from, many times smaller, and would
send them through the driver; the other sides grow with the words.

Defined results: null and empty texts have no words; a null doc_id counts as empty in the damage's checksum; a text's repeated rows count
each; an empty table, or one without frequent words, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.batches import pieces
from corpusq.plans.once import once
from corpusq.plans.workspace import Workspace

MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIME = np.uint64((1 << 31) - 1)
#: Bases of the four 31-bit sums of a name, and their inverses modulo PRIME.
BASES = (1_103_515_245, 1_664_525_013, 214_013_117, 1_812_433_253)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """word, n: the runs of Latin letters in small letters. damage: every so manieth occurrence (by checksum of document and run) loses a letter."""
    runs = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(f"[a-zÀ-ÿ]{{{min_length},}}+"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run"))
    if damage is None:
        words = words.select(F.col("run").alias("word"))
    else:
        words = once(words, sum=F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
        at = F.pmod("sum", F.length("run")).cast("int")
        left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = words.select(F.when(F.pmod("sum", F.lit(damage)) == 0, left).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), int(PRIME))) % PRIME))
    return out[:n]


def names(words: list[str]) -> tuple[np.ndarray, ...]:
    """(word's number, k1, k2, size, low, high): the name and size of each word and each distinct deletion.

    low and high are the first and last place whose character was left out, -1 and -1 for the word itself.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - (ends - sizes)[word]
    begins = np.flatnonzero((place == 0) | (codes != np.concatenate((codes[:1], codes[:-1]))))
    of, low = word[begins], place[begins]
    high = np.concatenate((begins[1:], [len(codes)])) - 1 - (ends - sizes)[of]
    sums = []
    for base in BASES:
        inverse = np.uint64(pow(base, -1, int(PRIME)))
        upto = np.concatenate(([0], np.cumsum(codes * powers(base, int(sizes.max(initial=0)))[place] % PRIME))).astype(np.uint64)
        first, last = upto[ends - sizes], upto[ends]
        front, behind = (upto[begins] - first[of]) % PRIME, (last[of] - upto[begins + 1]) % PRIME
        sums.append(np.concatenate(((last - first) % PRIME, (front + behind * inverse % PRIME) % PRIME)))
    k1, k2 = ((a << np.uint64(31) | b).astype(np.int64) for a, b in (sums[:2], sums[2:]))
    whole = np.full(len(words), -1)
    return np.concatenate((np.arange(len(words)), of)), k1, k2, np.concatenate((sizes, sizes[of] - 1)), np.concatenate((whole, low)), np.concatenate((whole, high))


def deletions(words: DataFrame) -> DataFrame:
    """k1, k2, size, id, n, low, high from words (id, n, word)."""
    fields = ["k1", "k2", "size", "id", "n", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2, 1 << 18):
            of, k1, k2, size, low, high = names(b.column(2).to_pylist())
            ids, n = (b.column(i).to_numpy() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (k1, k2, size.astype(np.int32), ids[of], n[of], low.astype(np.int32), high.astype(np.int32)))], fields)

    return words.select("id", "n", "word").mapInArrow(run, "k1 long, k2 long, size int, id long, n long, low int, high int")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best (n, minus_id of the most frequent near word) for words (id, n, word) that have one."""
    sent = deletions(words)
    other = sent.select("k1", "k2", "size", *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "low", "high")])
    whole = (F.col("low") < 0) | (F.col("other_low") < 0)
    replaced = (F.col("low") <= F.col("other_high")) & (F.col("other_low") <= F.col("high"))
    pairs = sent.join(other.hint("merge"), ["k1", "k2", "size"]).where((F.col("id") != F.col("other_id")) & (whole | replaced))
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct(F.col("other_n").alias("n"), (-F.col("other_id")).alias("minus_id"))).alias("best"))


def roots(links: DataFrame, ws: Workspace) -> DataFrame:
    """id, root from links (id, form): forms followed to the last, by joining the roots of roots."""
    now, i = ws.save("roots-0", links.select("id", F.col("form").alias("root"))), 0
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("above"))
        then = ws.save(f"roots-{i + 1}", now.join(up.hint("merge"), "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        ws.drop(f"roots-{i}")
        now, i = then.select("id", "root"), i + 1
        if then.where("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, ws: Workspace, *, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    counted = ws.save("counts", word_counts(docs, min_length, min_count, damage))
    words = ws.save("words", counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()))
    near = ws.save("near", near_words(words))
    frequent = words.select("id", "word", "n").join(near.hint("merge"), "id", "left").withColumn("fits", F.col("best.n") >= ratio * F.col("n"))
    frequent = ws.save("frequent", frequent.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("best.minus_id")).alias("form"), F.when(F.col("fits"), F.col("best.n")).alias("form_n")))
    root = roots(frequent.where("form is not null"), ws)
    named = words.select("id", "word")
    out = frequent.join(root.hint("merge"), "id", "left")
    out = out.join(named.select(F.col("id").alias("form"), F.col("word").alias("form_word")).hint("merge"), "form", "left")
    out = out.join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")).hint("merge"), "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def families(found: DataFrame) -> DataFrame:
    """root, words (how many lead to it, itself included), n (their occurrences) from the rows of `group_variants`."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))


def oracle(crc_sql) -> str:
    """DuckDB SQL for `group_variants` of documents with the production damage; crc_sql gives the SQL of a checksum."""
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
h AS (SELECT run, n, {crc_sql("(doc_id || ':' || run)")} AS h FROM u),
d AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
k AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS key FROM w, unnest(range(1, length(word) + 1)) AS x(i)),
p AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.key = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.key = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n FROM w LEFT JOIN near USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word JOIN f AS z ON r.at = z.word WHERE z.form IS NULL
"""
