"""The pipeline against brute force over the smallest tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_linededup import plain as plain_lines
from test_minhash import brute as brute_near
from test_mixing import plain as plain_mix

import corpus_pipeline as p
from corpusq.llm import bpe, mixing, quality
from corpusq.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good(text, rules=quality.Rules()):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))

    def inside(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    if len(words) < rules.min_words or 100 * len(inside(rules.base_window)) > rules.base_percent * len(words):
        return False
    if any(sum(len(words[j]) for j in inside(n)) > limit * chars for n, limit in rules.ngram_limits):
        return False
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    return sum((n - 1) * sum(map(len, WORD.findall(x))) for x, n in lines.items()) <= rules.line_limit * chars


def without_lines(rows):
    """doc_id -> text after line dedup; what loses all its lines is gone."""
    out = {}
    for (d, text), (_, n, gone, chars, sha) in zip(rows, plain_lines(rows)):
        if gone == n:
            continue
        out[d] = (text, sha)
    return out


def test_run_equals_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r for r in docs.collect()}

    stage = p.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in stage.collect()} == {d for d, r in source.items() if good(r.text)}

    rows = sorted((d, r.text) for d, r in source.items() if good(r.text))
    want = without_lines(rows)
    stage = p.line_dedup(spark, stage, SF)
    texts = {r.doc_id: r.text for r in stage.collect()}
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items()} == {d: sha for d, (_, sha) in want.items()}

    near = {d for d, _, _, kept in brute_near(sorted(texts.items())) if kept}
    stage = p.near_dedup(spark, stage, SF)
    assert {r.doc_id for r in stage.collect()} == near

    number = lambda s: re.search("([0-9]+)$", s or "")
    path = lambda r: (f"d{int(number(r.source)[1]) % 4}" if number(r.source) else mixing.NONE, r.lang or mixing.NONE, r.source or mixing.NONE)
    rows = [(d, path(source[d]), len(WORD.findall(texts[d] or ""))) for d in near]
    key = {r.doc_id: r.h for r in docs.select("doc_id", mixing.order_key(17, F.lit(0), F.col("doc_id")).alias("h")).collect()}
    chosen = plain_mix(rows, mixing.WEIGHTS, 0.9 * sum(t for *_, t in rows), 1, lambda epoch, d: key[d] if epoch == 0 else 0)
    stage = p.mix_sources(spark, stage, SF)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(r[0] for r in chosen)

    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want_rows = []
    for d in sorted(r[0] for r in chosen):
        ids = library.encode(texts[d] or "", add_special_tokens=False).ids
        want_rows.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, p.run(spark, SF).collect())) == want_rows


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("component", F.lit(1.5))
    names, seen = docs.columns, defaultdict(int)
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        seen[name] = docs.count()
    assert min(seen.values()) > 50


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_repeats_and_long_texts(spark):
    rng = random.Random(31)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    license_, copied, long = "all rights reserved by the owners of this site", text(80), text(150_000)
    rows = [
        (1, copied, "en", "src1"),
        (1, copied, "en", "src1"),
        (2, copied + " tail", "en", "src2"),
        (3, text(60) + "\n" + license_, "en", "src3"),
        (4, text(60) + "\n" + license_, None, "src3"),
        (5, text(60) + "\n" + license_, "en", None),
        (6, None, "en", "src1"),
        (7, "", "en", "src1"),
        (8, long, "en", "src1"),
        (None, text(50), "en", "src1"),
        (None, text(50), "en", "src1"),
        (None, copied, "en", "src1"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS drops", "2 AS epochs", "3 AS own_id")
    seen = {}
    for name, stage in p.STAGES:
        docs = Workspace(spark, "t").save(name, stage(spark, docs, SF))
        seen[name] = docs.collect()
        assert name == "bpe_coding" or docs.columns[-3:] == ["drops", "epochs", "own_id"]
    ids = lambda name: sorted((str(r.doc_id) for r in seen[name]))
    assert ids("quality_rules") == sorted(["1", "1", "2", "3", "4", "5", "8", "None", "None", "None"])
    lines = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert license_ in lines[3] and license_ not in lines[4] + lines[5] and lines[8] == long
    assert ids("minhash_near_dedup") == sorted(["1", "3", "4", "5", "8", "None", "None"])
    assert {r.doc_id for r in seen["mix_sources"]} <= {1, 3, 4, 5, 8, None} and len(seen["bpe_coding"]) == len(seen["mix_sources"])


def test_tables_go_with_their_stage(spark, monkeypatch):
    from corpusq.plans import workspace

    before = len(workspace._open)
    p.run(spark, SF).count()
    assert len(workspace._open) == before + 1
    at = workspace._open[-1].path
    jvm = spark.sparkContext._jvm
    names = [f.getPath().getName() for f in jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm.org.apache.hadoop.fs.Path(at))]
    assert names == ["mix_sources"]
