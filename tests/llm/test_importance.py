"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from llm_fixtures import sentence
from pyspark.sql import functions as F

from corpusq.llm import importance
from corpusq.plans.workspace import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def codes(text):
    w = WORD.findall((text or "").translate(SMALL))
    return [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target):
    counted = [(i, *codes(t)) for i, t in docs]
    s, t = ([0] * 10000 for _ in range(2))
    for _, found, _ in counted:
        for c in found:
            s[c] += 1
    for x in target:
        for c in codes(x)[0]:
            t[c] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, found, words in counted:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c] for c in found)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return {r[0]: (*r[1:4], rank.get(r[0]) if r[4] >= 20 else None) for r in rows}


def made(n, seed=1):
    rng = random.Random(seed)
    texts = [(i, sentence(rng, rng.randrange(5, 60)) + ". ÉTÉ Straße_x Ünï\u0000") for i in range(n)]
    return [*texts, (n, None), (n + 1, ""), (n + 2, "... !!"), (n + 3, texts[0][1]), (n + 4, "word " * 3000), (None, "lone " * 30)]


def test_equal_to_plain(docs, spark):
    rows = made(300)
    target = ["alpha beta gamma delta", "alpha1 beta2", None, "été"]
    got = importance.importance(docs(rows, extra=True), spark.createDataFrame([(t,) for t in target], "text string"), Workspace(spark, "t"))
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()} == plain(rows, target)


def test_many_ranges_and_ties(docs, spark):
    rows = [(i, "same words in every text of this large group of copies that are all equal in all of their words " * 2) for i in range(500)]
    got = {r.doc_id: r["rank"] for r in importance.importance(docs(rows), spark.createDataFrame([("x",)], "text string"), Workspace(spark, "t"), percent=50).collect()}
    flat = spark.createDataFrame([(i, 30, 7) for i in range(100)] + [(None, 30, 7)], "doc_id long, n_words long, score long")
    tied = {r.doc_id: r["rank"] for r in importance.ranked(flat, Workspace(spark, "t"), 40).collect()}
    assert sorted(x for x in got.values() if x) == list(range(1, 251))
    assert tied == {i: i + 1 if i is not None and i < 40 else None for i in [*range(100), None]}


def test_portions_do_not_change_features():
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(0, 50)).encode() for _ in range(40)]

    def counts(limit):
        words, total = np.zeros(40, int), {}
        for of_words, of, code in importance.features(texts, 1 << 32, limit):
            words += np.bincount(of_words, minlength=40)
            for key in zip(of.tolist(), code.tolist()):
                total[key] = total.get(key, 0) + 1
        return words.tolist(), total

    whole = counts(1 << 30)
    assert sum(whole[1].values()) == sum(max(n - k, 0) for n in whole[0] for k in range(3))
    for limit in (1, 7, 40, 300):
        assert counts(limit) == whole


def test_empty_tables_and_vectors_of_tasks(docs, spark):
    none, target = docs([]), spark.createDataFrame([], "text string")
    assert importance.importance(none, target, Workspace(spark, "t")).collect() == []
    d = docs([f"w{i % 7} x" for i in range(90)])
    for parts in (1, 3, 40):
        assert importance.count_buckets(d.repartition(parts)).sum() == 90 * 3
    assert importance.count_buckets(d.where("doc_id < 0")).sum() == 0
    assert set(importance.gains(np.zeros(10, int), np.zeros(10, int)).tolist()) == {0}


def test_resample_keeps_rows_and_names(docs, spark):
    rows = [(i, f"w{i} " * 25) for i in range(60)]
    d = docs(rows, extra=True).withColumn("drawn_id", F.lit("own")).withColumn("rank", F.lit(0))
    got = importance.resample(d, spark.createDataFrame([("w7 w7 w7",)], "text string"), Workspace(spark, "t"))
    assert got.columns == d.columns and got.count() == 3 and {r.drawn_id for r in got.collect()} == {"own"}
    assert 7 in {r.doc_id for r in got.collect()}


def test_a_seed_draws_by_weight():
    assert importance.noise(1) != importance.noise(1, 43) and importance.noise(None) == importance.noise("")
    assert np.mean([importance.noise(i) for i in range(4000)]) == pytest.approx(577, abs=60)
