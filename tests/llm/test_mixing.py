"""Hierarchical budgets and seeded prefixes against a plain version."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusq.llm import mixing
from corpusq.plans.workspace import Workspace

LEVELS = ["domain", "lang", "source"]


def fill(budget, children):
    """children: name -> (weight, capacity); sharing by repeated redistribution."""
    out, left, live = dict.fromkeys(children, 0.0), budget, {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while live and left > 1e-9:
        total = sum(children[k][0] for k in live)
        full = {k for k in live if children[k][1] - out[k] <= left * children[k][0] / total + 1e-12}
        if not full:
            for k in live:
                out[k] += left * children[k][0] / total
            break
        for k in full:
            left -= children[k][1] - out[k]
            out[k] = children[k][1]
        live -= full
    return out


def plain_budgets(tokens, weights, budget, epochs):
    def down(prefix, amount):
        if len(prefix) == len(LEVELS):
            return {prefix: amount}
        names = sorted({k[len(prefix)] for k in tokens if k[: len(prefix)] == prefix})
        reached = lambda k: all(weights[d].get(k[d], 1.0) > 0 for d in range(len(prefix) + 1, len(LEVELS)))
        cap = lambda n: epochs * sum(t for k, t in tokens.items() if k[: len(prefix) + 1] == (*prefix, n) and reached(k))
        got = fill(amount, {n: (weights[len(prefix)].get(n, 1.0), cap(n)) for n in names})
        return {k: v for n in names for k, v in down((*prefix, n), got[n]).items()}

    return down((), budget)


def plain(rows, weights, budget, epochs, key):
    tokens = defaultdict(int)
    for _, path, t in rows:
        tokens[path] += t
    out = []
    for path, share in plain_budgets(tokens, weights, budget, epochs).items():
        if not tokens[path]:
            continue
        whole, rest = divmod(math.floor(share + 1e-6), tokens[path])
        mine = sorted((key(whole, d), -(1 << 63) if d is None else d, t) for d, p, t in rows if p == path)
        cut, total, i = None, 0, 0
        while i < len(mine):
            j = i
            while j < len(mine) and mine[j][:2] == mine[i][:2]:
                total += mine[j][2]
                j += 1
            if total > rest:
                break
            cut, i = mine[i][:2], j
        for d, p, t in rows:
            if p == path:
                n = whole + (rest > 0 and cut is not None and (key(whole, d), -(1 << 63) if d is None else d) <= cut)
                out += [(d, *path, t, e) for e in range(n)]
    return out


def run(spark, rows, weights, budget, epochs, seed=5):
    frame = spark.createDataFrame([(d, " ".join(["w"] * t), *p, "x") for d, p, t in rows], "doc_id long, text string, domain string, lang string, source string, epoch string")
    got = mixing.choose(frame, Workspace(spark, "mix"), LEVELS, weights, budget=budget, max_epochs=epochs, seed=seed).collect()
    keys = {(r.e, r.doc_id): r.h for r in spark.range(epochs + 1).withColumnRenamed("id", "e").join(frame.select("doc_id").distinct()).select("e", "doc_id", mixing.order_key(seed, F.col("e"), F.col("doc_id")).alias("h")).collect()}
    none = lambda p: tuple(mixing.NONE if x is None else x for x in p)
    want = plain([(d, none(p), t) for d, p, t in rows], weights, budget, epochs, lambda e, d: keys[e, d])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


def test_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(4)
    rows = []
    for i in range(400):
        path = ("d" + str(rng.choice([0, 0, 0, 1, 2])), rng.choice(["en", "en", "de", None]), "s" + str(rng.randrange(3)))
        rows.append((i, path, rng.choice([0, 1, 5, 40])))
    rows += [rows[0], rows[0], (None, ("d1", "en", "s0"), 4), (None, ("d1", "en", "s0"), 4)]
    total = sum(t for *_, t in rows)
    weights = [{"d0": 0.2, "d1": 3.0}, {"de": 2.0, "en": 0.0}, {"s1": 0.5}]
    for budget, epochs in ((total * 0.3, 1), (total * 1.1, 2), (total * 5, 2), (0, 1), (17, 3)):
        got = run(spark, rows, weights, budget, epochs)
        assert sum(r.tokens for r in got) <= budget + 1e-6


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, ("a", "x", "s"), 10) for i in range(2)] + [(10 + i, ("a", "y", "s"), 10) for i in range(50)] + [(100 + i, ("b", "z", "s"), 10) for i in range(50)]
    got = run(spark, rows, [{}, {}, {}], 400, 1)
    took = defaultdict(int)
    for r in got:
        took[r.domain, r.lang] += r.tokens
    assert took == {("a", "x"): 20, ("a", "y"): 180, ("b", "z"): 200}


def test_mix_keeps_columns(spark, docs):
    d = docs(["a b c", None, "d e f", ""] * 30, extra=True)
    out = mixing.mix(d, Workspace(spark, "mix"), mixing.production_levels(), mixing.WEIGHTS, fraction=0.5, seed=1)
    assert out.columns == d.columns and 0 < out.count() < 120
    assert mixing.mix(d.limit(0), Workspace(spark, "mix"), mixing.production_levels(), mixing.WEIGHTS).count() == 0


def test_names_do_not_clash(spark, docs):
    names = ["epochs", "rest", "cutoff", "epoch", "tokens", "row", "level_0", "level_1", "_level_domain", "bucket", "share"]
    d = docs([(i, "a b c d e") for i in range(40)] + [(None, None), (7, "x"), (50, "long " * 200_000)])
    d = d.selectExpr("*", *[f"{i} + doc_id AS {c}" for i, c in enumerate(names)])
    got = mixing.mix(d, Workspace(spark, "mix"), {"epoch": F.col("lang"), "rest": F.col("source")}, [{}, {}], seed=3)
    assert got.columns == d.columns
    want = {str(r) for r in d.collect()}
    rows = [str(r) for r in got.collect()]
    assert len(rows) == 43 and set(rows) == want
    with pytest.raises(ValueError, match="epoch"):
        mixing.choose(d, Workspace(spark, "mix"), ["epoch"], [{}])
    some = mixing.choose(d.select("doc_id", "text", F.col("lang").alias("rest"), F.col("source").alias("cutoff"), F.lit(1).alias("level_0")), Workspace(spark, "mix"), ["rest", "cutoff"], [{}, {}])
    assert some.columns == ["doc_id", "rest", "cutoff", "tokens", "epoch"] and some.count() == 43


@pytest.mark.parametrize("level", [0, 1, 2])
def test_what_a_weight_of_zero_bars_is_no_capacity(spark, level):
    """Budgets that a barred child can't take go to its parent's siblings, on every level."""
    barred = [("b", "x", "s"), ("a", "y", "s"), ("a", "x", "s2")][level]
    rows = [("a", "x", "s", 100), (*barred, 900), ("c", "x", "s", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = [{}, {}, {}]
    weights[level] = {barred[level]: 0.0}
    got = {tuple(r)[:3]: r.share for r in mixing.budgets(leaves, LEVELS, weights, 1000, 1).collect()}
    assert got == {("a", "x", "s"): pytest.approx(100), barred: 0.0, ("c", "x", "s"): pytest.approx(900)}
