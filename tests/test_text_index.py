"""The trigram index against scans."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusq.functions.text import matches
from corpusq.operators import text_index
from corpusq.operators.text_index import fold, grams, required

PATTERNS = ["moron|disgusting", "the", "(?:foo|ba[rz])+qux", "a.c", "colou?r", "abc{2,3}d", "(abc|)def", "x*abcd", r"\bword\b", "a|bcd", "[abc]def", "ab(cd)ef", "(ab){2}c", "", "no such thing", r"\p{L}+ing", "ß|straſse", "KELVIN", "(?i)abc", r"\Qa.c\E", "x(?=yz)yzab", "é.*ción", "new\nline", "[a-z&&[abc]]def", r"12\.5", "(unclosed"]


def holds(formula, have):
    if formula is True or isinstance(formula, int) and formula is not True:
        return formula is True or formula in have
    return (all if formula[0] == "and" else any)(holds(f, have) for f in formula[1])


@settings(max_examples=800, deadline=None)
@given(st.sampled_from([p for p in PATTERNS if "(unclosed" not in p and "&&" not in p and "\\p" not in p and "\\Q" not in p]), st.lists(st.sampled_from(["abc", "ABCD", "def", "foo", "qux", "baz", "colour", "color", "word", " ", "bcd", "xyzab", "é", "ción", "ab", "c", "cd", "ef", "new\n", "line", "12.5", "the", "x"]), max_size=8).map("".join))
def test_a_match_fulfils_the_formula(pattern, text):
    if re.search(pattern, text, re.I):
        assert holds(required(pattern), set(grams(text).tolist()))


def test_formulas():
    assert required("ab") is True and required("a|bcd") is True and required(r"\p{L}+ing") is True and required("(unclosed") is True
    assert required("abcd") == ("and", tuple(sorted(grams("abcd").tolist()))) and required("a.c", literal=True) == int(grams("a.c")[0])
    assert required("abc|def")[0] == "or" and "".join(map(chr, fold("ſKÉABC"))) == "skéabc"


def test_searches_equal_scans(spark, tmp_path):
    rng = random.Random(4)
    words = ["abcd", "def", "foo", "qux", "colour", "color", "word", "bcd", "xyzab", "été acción", "Straße", "STRASSE", "straſſe", "Kelvin", "new\nline", "12.5", "The", "moron", "ABC", "foobarqux"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 6))), None if i % 3 else f"id-colour-{i}") for i in range(300)] + [(300, None, None), (301, "", "x")]
    df = spark.createDataFrame(rows, "i long, text string, name string").repartition(5)
    index = text_index.build(df, f"file://{tmp_path}/index", ["text", "name"])
    for p in PATTERNS[:-1]:
        want = sorted(r.i for r in df.where(matches(p, F.col("text"), F.col("name"))).collect())
        found = index.search(p)
        assert sorted(r.i for r in found.collect()) == want and found.columns == df.columns, p
    assert sorted(r.i for r in index.search("a.c", literal=True).collect()) == []
    assert index.search("12.5", literal=True).count() == df.where(F.contains("text", F.lit("12.5"))).count()


def test_only_blocks_of_candidates_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_ROWS", 16)
    df = spark.range(400).select("id", F.when(F.col("id") == 37, "needle").otherwise("hay").alias("text")).coalesce(1)
    index = text_index.build(df, f"file://{tmp_path}/index", ["text"])
    found = index.search("needles?")
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "PushedFilters: [In(gram" in plan
    assert [r.id for r in found.collect()] == [37]
    with pytest.raises(ValueError, match="names"):
        text_index.build(df.withColumn("Row", F.lit(1)), f"file://{tmp_path}/other", ["text"])


def test_empty_table(spark, tmp_path):
    index = text_index.build(spark.createDataFrame([], "i long, text string"), f"file://{tmp_path}/index", ["text"])
    assert index.search("abc").count() == index.search("a").count() == 0


def test_postings_are_rows_of_bits(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    texts = [None if i % 50 == 9 else "" if i % 50 == 8 else "".join(rng.choices("abcd", k=rng.randrange(1, 40))) for i in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").selectExpr("*", "i AS word", "i AS rows_of_word").repartition(3)
    index = text_index.build(df, f"file://{tmp_path}/index", ["text"])
    rows = {r.row: r.text for r in index.rows.collect()}
    want = {(int(g), n) for n, t in rows.items() for g in grams(t or "")}
    got = [(r.gram, r.word << 6 | k) for r in index.postings.collect() for k in range(64) if r.rows >> k & 1]
    assert len(got) == len(want) and set(got) == want and index.postings.count() < len(want) / 8
    for most in (1 << 10, 0):  # with candidates by the row, and by the block only
        monkeypatch.setattr(text_index, "MOST_BLOCKS", most)
        for p in ["abcd", "(abc|bcd)a+", "aaa.*bbb", "dcba|cccc"]:
            assert sorted(r.i for r in index.search(p).collect()) == [i for i, t in enumerate(texts) if t and re.search(p, t)], p


def test_the_pattern_is_tried_on_candidates_only(spark, tmp_path):
    index = text_index.build(spark.range(300).selectExpr("id", "concat('hay', id) AS text"), f"file://{tmp_path}/index", ["text"])
    plan = index.search("hay1.*7")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tried = [i for i, x in enumerate(plan) if "RLIKE" in x]
    assert len(tried) == 1 and tried[0] <= next(i for i, x in enumerate(plan) if "Join Inner" in x)  # at the join with the candidates, or above it
