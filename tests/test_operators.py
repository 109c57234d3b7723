"""Sources, sinks, cleaning, duplicates, anomalies, simulation and streaming."""

import hashlib
import json
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusq.functions import pii
from corpusq.functions.chunk import chunks_of
from corpusq.functions.score import API, STAGED
from corpusq.operators import anomaly, clean, duplicates, reports, simulate
from corpusq.plans import linkage, pipeline, workspace
from corpusq.plans.components import connected_components
from corpusq.plans.workspace import Workspace
from corpusq.sources import readers, writers
from corpusq.streaming import scorer

LONG = "This is a perfectly fine sentence with more than twenty words in it, so that it stays when short ones go away. "


@pytest.fixture
def raw(spark):
    texts = [LONG * 6, LONG * 6, "Zebras quietly juggle vivid xylophones beyond foggy quarries while jovial wizards kept mixing black potions, mail a@b.co now, ok, bye", None, "  ", "short", "é" * 30 + LONG[:40], LONG * 8 + " end"]
    rows = [(str(i), "u", "b", 1.0 + i % 5, 0, 0, 0, t, f"2020-0{1 + i % 3}-01 00:00:00") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, text string, date string")


def test_funnel_follows_clean(raw):
    rows = clean.funnel(raw).orderBy("step_no").collect()
    assert [r.n for r in rows][:3] == [8, 7, 6] and rows[-1].n == clean.clean(raw).count()
    assert clean.funnel(raw.limit(0)).orderBy("step_no").first().n == 0


def test_staged_scores_and_layers(spark, raw, tmp_path):
    df = pipeline.scored(raw, ws=Workspace(spark, "t"))
    path = f"file://{tmp_path}/gold"
    writers.write_layer(df, path)
    back = spark.read.parquet(path)
    assert len(back.columns) == 25
    dup = {r.review_id: r.is_duplicate for r in back.collect()}
    assert dup["0"] and dup["1"] and not dup["2"]
    writers.assert_layer(back, ["text"], ["text"], {"token_count": 20}, back.count())
    with pytest.raises(AssertionError):
        writers.assert_layer(back, ["absent"])
    writers.overwrite_in_place(spark, back.where("not is_duplicate"), path)
    assert spark.read.parquet(path).count() < len(dup)


def test_json_sources(spark, tmp_path):
    rows = [{"review_id": str(i), "stars": 4.0, "text": f"text {i}\nwith line"} for i in range(5)]
    lines, array = tmp_path / "a.jsonl", tmp_path / "b.json"
    lines.write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    array.write_text(json.dumps(rows))
    assert readers.count_lines(spark, str(lines)) == 6 and readers.read_jsonl(spark, str(lines)).count() == 5
    assert readers.count_malformed(spark, str(lines)) == 1
    assert readers.read_json(spark, str(lines)).count() == 5 and readers.read_json(spark, str(array)).count() == 5
    assert readers.read_first(spark, str(lines), 2).count() == 2
    assert readers.sample_exact(readers.read_json(spark, str(array)), 3, "review_id").count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_json(spark, str(tmp_path / "none.json"))


def test_csv_and_vectors(spark, raw, tmp_path):
    df = pipeline.scored(raw, ws=Workspace(spark, "t")).withColumn("text", F.concat(F.lit('a "q", \n'), "text"))
    writers.write_csv(writers.export_ready(df), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in writers.export_ready(df).collect())
    writers.write_csv(writers.export_pii(df), str(tmp_path / "pii"))
    found = writers.read_csv(spark, str(tmp_path / "pii"), "review_id string, text string, pii_types string, index_readiness_score double").collect()
    assert [(r.review_id, r.pii_types) for r in found] == [("2", '["email"]')]
    assert writers.vector_batches(df, 1).groupBy("partition", "batch").count().agg(F.max("count")).first()[0] == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = connected_components(Workspace(spark, "cc"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(51)} | {(100, 100), (101, 100)}
    assert connected_components(Workspace(spark, "cc"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_lsh_against_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = {(r.a, r.b): r.jaccard for r in duplicates.jaccard_pairs(docs, Workspace(spark, "p")).collect()}
    flagged = {r.doc_id for r in duplicates.lsh(docs, Workspace(spark, "l"), "doc_id").where("is_duplicate").collect()}
    sure = {i for (a, b), j in pairs.items() if j > 0.97 for i in (a, b)}
    assert pairs and sure <= flagged


def test_anomalies(spark):
    def series(values):
        return spark.createDataFrame([(f"2020-{i + 1:02d}", float(v), 0.0, 1) for i, v in enumerate(values)], "period string, metric_mean double, metric_std double, review_count long")

    flat = anomaly.detect(series([5] * 6)).collect()
    assert not any(r.is_anomaly for r in flat) and {r.zscore for r in flat} == {0.0}
    got = {r.period: r for r in anomaly.detect(series([5, 5, 5, 5, 5, 5, 5, 50]), "iqr").collect()}
    assert got["2020-08"].anomaly_type == "high" and got["2020-08"].anomaly_severity == float("inf")
    moving = anomaly.detect(series([10, 10, 10, 5]), "moving_avg").orderBy("period").collect()
    assert [r.is_anomaly for r in moving] == [False, False, False, True] and moving[0].moving_avg is None
    s = anomaly.summary(anomaly.detect(series([10, 10, 10, 5]), "moving_avg")).first()
    assert (s.total_periods, s.anomaly_count, s.low_quality_periods) == (4, 1, ["2020-04"])
    assert anomaly.summary(anomaly.detect(series([]))).first().anomaly_rate == 0.0
    with pytest.raises(ValueError, match="unknown"):
        anomaly.detect(series([1]), "other")


def test_simulation_without_kept_rows(spark, raw):
    df = pipeline.scored(raw, ws=Workspace(spark, "t"))
    assert simulate.compare(df, 101).first().with_filter is None
    assert reports.service_cost(df.limit(0)).first().annual_savings is None


def test_stream(spark, tmp_path):
    rows = [("a", LONG * 3, 4.0), ("b", "short", 4.0), ("c", LONG * 3, 9.0), ("d", None, 1.0)]
    spark.createDataFrame(rows, "review_id string, text string, stars double").write.parquet(str(tmp_path / "in"))
    requests = spark.readStream.schema("review_id string, text string, stars double").parquet(str(tmp_path / "in"))
    full = requests.withColumns({c: F.lit(None).cast("string") for c in ("user_id", "business_id", "date")} | {c: F.lit(0).cast("long") for c in ("useful", "funny", "cool")})
    q = scorer.serve(full, str(tmp_path / "out"), str(tmp_path / "cp"), API)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.review_id for r in out] == ["a"] and out[0].duplicate_score == 100
    bad = scorer.rejected_stream(spark.createDataFrame(rows, "review_id string, text string, stars double"))
    assert {r.review_id for r in bad.collect()} == {"b", "c", "d"}


def test_jaccard_documents_have_every_copy(spark):
    near = "a long sentence that comes again with one more letter"
    rows = [(3, "only copies here"), (1, "only copies here"), (5, near), (4, near), (6, near + "s"), (7, None), (8, None), (9, "by itself")]
    got = duplicates.jaccard_documents(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "jd")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0), (3, 1, 0), (4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 7, 0), (8, 8, 0), (9, 9, 0)]


def test_sample_is_the_same_with_and_without_a_bound(spark):
    df = spark.range(5000).selectExpr("id AS review_id", "1 AS digest")
    least = sorted(range(5000), key=lambda i: hashlib.md5(f"42-{i}".encode()).hexdigest())
    for k in (1, 20, 700, 4000, 6000):
        got = readers.sample_exact(df, k, "review_id")
        assert got.columns == df.columns and sorted(r.review_id for r in got.collect()) == sorted(least[:k])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_keep_first_of_rows_that_share_a_key(spark):
    rows = [("a", "t"), ("a", "t"), ("b", "t"), (None, "t"), ("c", None), ("d", None), (None, "u"), (None, "u")]
    df = spark.createDataFrame(rows, "review_id string, text string").selectExpr("*", "1 AS _t", "2 AS text_digest", "3 AS first_key")
    got = duplicates.keep_first(df)
    assert got.columns[:5] == df.columns
    assert rows_of(got.select("review_id", "text", "is_duplicate")) == sorted([("a", "t", False)] * 2 + [("b", "t", True), (None, "t", True), ("c", None, False), ("d", None, False)] + [(None, "u", False)] * 2, key=str)
    assert got.where("is_duplicate = (duplicate_cluster_id = -1)").isEmpty()
    assert rows_of(duplicates.members(df).select("review_id", "is_duplicate").distinct()) == sorted([("a", True), ("b", True), (None, True), ("c", False), ("d", False)], key=str)


@pytest.mark.parametrize("find", [duplicates.lsh, duplicates.verified])
def test_near_duplicates_keep_all_columns(spark, find):
    rows = [("a", LONG * 2), ("b", LONG * 2), ("c", LONG * 2 + "x"), ("d", "zebras juggle vivid xylophones"), ("e", "ab"), ("f", None), (None, LONG * 2), ("d", "something else entirely, not like it")]
    df = spark.createDataFrame(rows, "review_id string, text string").selectExpr("*", "1 AS id", "2 AS cluster", "3 AS node", "4 AS cluster_name", "5 AS t")
    got = find(df, Workspace(spark, "near"))
    assert got.columns == [*df.columns, "is_duplicate", "duplicate_cluster_id"] and got.count() == 8
    flags = {r.review_id: (r.is_duplicate, r.duplicate_cluster_id) for r in got.collect()}
    assert flags["a"][0] and flags["a"] == flags["b"] == flags["c"] and flags["d"] == flags["e"] == flags["f"] == flags[None] == (False, -1)
    assert {(r.id, r.cluster, r.t) for r in got.collect()} == {(1, 2, 5)}
    assert find(df.limit(0), Workspace(spark, "near")).count() == 0


def test_verified_equals_all_pairs(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    texts = []
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(90)) for _ in range(60)]
        for _ in range(rng.choice([1, 3, 9])):
            texts.append(" ".join(w if rng.random() > 0.04 else "q" + str(rng.randrange(999)) for w in base))
    texts += ["ab", "ab", "Xy z", "xY Z"]
    grams = [{t.lower()[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or grams[i] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    names = [f"r{i:04d}" for i in range(len(texts))]
    want = sorted((names[i], min(n for n, r in zip(names, root) if r == root[i])) for i in range(len(texts)) if root.count(root[i]) > 1)
    df = spark.createDataFrame(list(zip(names, texts)), "review_id string, text string")
    assert rows_of(duplicates.verified_clusters(df, Workspace(spark, "v"))) == want and len(want) > 50


def test_group_numbers_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "RANGE_SAMPLE", 9)
    rng = random.Random(3)
    rows = [(f"k{i:04d}", f"text {rng.randrange(120)}") for i in range(400)] + [("z1", None), ("z2", None)]
    rng.shuffle(rows)
    first = {}
    for k, t in sorted(rows):
        first.setdefault(t, []).append(k)
    order = sorted(v[0] for t, v in first.items() if t and len(v) > 1)
    want = sorted((k, order.index(v[0])) for t, v in first.items() if t and len(v) > 1 for k in v)
    df = spark.createDataFrame(rows, "review_id string, text string")
    assert rows_of(duplicates.group_numbers(df, Workspace(spark, "g"))) == want
    assert duplicates.group_numbers(df.limit(0), Workspace(spark, "g")).count() == 0


def test_linkage_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(linkage, "ROWS", 16)
    rng = np.random.default_rng(5)
    sets = {i: np.unique(rng.integers(0, 60, 12).astype("<u8")) for i in range(150)}
    sets |= {200 + i: np.unique(np.append(sets[i], np.uint64(1000 + i))) for i in range(40)}
    sets |= {300: np.arange(5000, dtype="<u8"), 301: np.arange(4000, dtype="<u8")}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    keyed = spark.createDataFrame([(7, i) for i in sets] + [(8, i) for i in sets if i % 2], "key long, node long")
    table = spark.createDataFrame([(i, len(x), x.tobytes()) for i, x in sets.items()], "node long, n long, elements binary")
    got = linkage.similar_components(Workspace(spark, "ln"), keyed, lambda nodes: table.join(nodes, "node", "left_semi"), 75)
    sizes = Counter(root.values())
    assert {(r.node, r.component) for r in got.collect()} == {(i, r) for i, r in root.items() if sizes[r] > 1}


def test_many_small_sets_in_one_bucket(spark):
    n = 50_000
    ids = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"))

    def sets_of(nodes):
        def run(batches):
            for b in batches:
                own = [np.sort(np.array([5 * i, 5 * i + 1, 5 * i + 2, 5 * i + 3, 10**9], "<u8")) for i in (x // 2 * 2 for x in b.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([5] * len(own), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "n", "elements"])

        return nodes.mapInArrow(run, "node long, n long, elements binary")

    got = linkage.similar_components(Workspace(spark, "many"), ids, sets_of, 75)
    assert got.where("component <> node - node % 2").isEmpty() and got.count() == n


def test_unknown_duplicates_and_counters(spark, raw):
    with pytest.raises(ValueError, match="unknown kind"):
        pipeline.scored(raw, replace(STAGED, duplicates="jacard"))
    by_four = pipeline.Tokens.of(lambda t: len(t) // 4)
    df = pipeline.scored(raw, replace(STAGED, duplicates="none"), tokens=by_four)
    for r in df.collect():
        text = r.text
        assert r.token_count == len(text) // 4 and r.chunk_count == len(chunks_of(text, counter=by_four.counter))
    assert pipeline.scored(raw, replace(STAGED, duplicates="jaccard"), Workspace(spark, "t")).where("is_duplicate").count() == 3


def test_batches(spark):
    rows = [(1, "a", LONG, 4.0), (1, "b", LONG * 6, 4.0), (2, "c", LONG, 4.0), (2, "d", LONG, 9.0), (None, "e", LONG, 1.0)] + [(3, f"x{i}", LONG, 2.0) for i in range(101)]
    df = spark.createDataFrame(rows, "batch int, review_id string, text string, stars double")
    errors = {r.review_id: r.error for r in clean.validate_batches(df, "batch").collect()}
    assert errors["a"] is None and errors["e"] is None and errors["c"] == "another row of the batch is invalid" and "stars" in errors["d"] and "100 rows" in errors["x7"]
    assert {(r.batch, r.total_reviews) for r in scorer.score_batches(df, "batch").collect()} == {(1, 2), (None, 1)}


def test_redact_table(spark):
    rows = [("a", "mail a@b.co or 555-123-4567", ["phone"]), ("b", "mail a@b.co", []), ("c", "mail a@b.co", None), ("d", None, None), ("e", "  ", ["email"])]
    df = spark.createDataFrame(rows, "review_id string, text string, pii_types_list array<string>").withColumn("redacted", F.lit(1))
    got = {r.review_id: r for r in pii.redact_table(df).collect()}
    assert [got[k].redactions_made for k in "abcde"] == [1, 0, 1, 0, 0] and got["a"].redacted_text == "mail a@b.co or [PHONE REDACTED]" and got["b"].redacted_text == "mail a@b.co"
    assert got["d"].redacted_text is None and got["e"].redaction_rate == 0.0 and got["a"].redaction_rate == 0.25
    assert pii.redact_table(df.drop("pii_types_list")).columns == ["review_id", "original_text", "redacted_text", "redactions_made", "redaction_rate"]


def test_windowed_log(spark, tmp_path):
    log = [("2024-01-01 00:00:10", 5.0), ("2024-01-01 00:00:50", 7.0), ("2024-01-01 00:01:10", 1.0)]
    df = spark.createDataFrame(log, "ts string, latency_ms double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.requests, r.mean_ms) for r in scorer.stats_per_window(df).orderBy("start").collect()] == [(2, 6.0), (1, 1.0)]


def test_overwrite_leaves_one_table(spark, tmp_path):
    path = f"file://{tmp_path}/layer"
    spark.range(10).write.parquet(path)
    for n in (6, 3):
        writers.overwrite_in_place(spark, spark.read.parquet(path).limit(n), path)
        assert spark.read.parquet(path).count() == n
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["layer"]


def test_scratch(spark):
    outer = Workspace(spark, "outer")
    with workspace.scratch():
        inner = Workspace(spark, "inner")
        kept = outer.save("t", inner.save("t", spark.range(3).toDF("id")))
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(f"{inner.path}/t")


def test_jaccard_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "ROWS", 7)
    rng = random.Random(9)
    base = [rng.choice("abcdefghij ") for _ in range(300)]
    texts = ["".join(base[: rng.randrange(60, 300)]) + "".join(rng.choice("xyz") for _ in range(rng.randrange(8))) for _ in range(60)] + ["abc", "ABC", "ab", None, "abc"]
    grams = [{t.lower()[i : i + 3] for i in range(len(t) - 2)} if t else set() for t in texts]
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    ids = sorted(i for t, i in first.items() if t)
    want = []
    for i in ids:
        for j in ids:
            if i < j and grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9:
                want.append((i, j, len(grams[i] & grams[j]) / len(grams[i] | grams[j])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, duplicates.jaccard_pairs(df, Workspace(spark, "jp")).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(want) > 50
    assert all(abs(r[2] - w[2]) < 1e-6 for r, w in zip(got, want))
    assert duplicates.jaccard_pairs(df.limit(0), Workspace(spark, "jp")).count() == 0


def test_exact_join_moves_full_sets_only_where_they_can_be_similar(spark, monkeypatch):
    monkeypatch.setattr(duplicates.linkage, "ROWS", 3)
    monkeypatch.setattr(duplicates.linkage, "SLICE", 16)
    for name, value in (("SKETCHES", 9), ("MATRIX", 40), ("DEALT", 1)):
        monkeypatch.setattr(duplicates, name, value)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    texts = []
    for size in (20, 25, 31):
        for _ in range(12):
            texts.append(" ".join(word() for _ in range(size)))
        for t in texts[-3:]:
            texts += [f"{t} {word()}", f"{t} {word()} {word()}", t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ws = Workspace(spark, "jm")
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    sets = {i: set(duplicates.trigrams(t).tolist()) for t, i in first.items()}
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(want) >= 9 and sorted((r.a, r.b) for r in duplicates.jaccard_pairs(df, ws).collect()) == want
    met = spark.read.parquet(f"{ws.path}/met-*")
    linked = {x for pair in want for x in pair}
    assert {r.id for r in met.collect()} >= linked and met.select("id").distinct().count() < len(sets)
    got = {r.doc_id: (r.class_id, r.n_links) for r in duplicates.jaccard_documents(df, Workspace(spark, "jn")).collect()}
    assert got == {i: (first[t], sum(first[t] in pair for pair in want)) for i, t in enumerate(texts)}
