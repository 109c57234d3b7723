"""Table functions in SQL, samples in one scan, and band parameters."""

import collections

import pytest
from pyspark.sql import functions as F

from corpusq.functions import tables
from corpusq.functions.chunk import chunks_of
from corpusq.operators import duplicates
from corpusq.plans.workspace import Workspace
from corpusq.sources import readers


def test_lateral_rows_have_places(spark):
    tables.register(spark)
    text = "Ünï said it. Call 555-123-4567 or write to a.b@c.de now! Then stop."
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "One. Two " * 400)], "i int, text string")
    rows = spark.sql("SELECT d.i, s.* FROM {d} d, LATERAL sentences_of(d.text) s", d=d).collect()
    assert [text[r.start : r.end] for r in rows if r.i == 1] == [r.text for r in rows if r.i == 1] == ["Ünï said it.", "Call 555-123-4567 or write to a.b@c.de now!", "Then stop."]
    found = spark.sql("SELECT d.i, p.* FROM {d} d, LATERAL personal_data_in(d.text) p", d=d).collect()
    assert [(r.kind, text[r.start : r.end]) for r in found] == [("email", "a.b@c.de"), ("phone", "555-123-4567")] and all(r.found == text[r.start : r.end] for r in found)
    got = spark.sql("SELECT d.i, c.* FROM {d} d, LATERAL chunks_of(d.text, 50, 0) c", d=d).where("i = 4").collect()
    assert [(r.text, r.tokens, r.sentences) for r in got] == chunks_of("One. Two " * 400, 50, 0)
    assert {r.i for r in rows} == {1, 4}


def test_partitions_and_wrong_arguments(spark):
    tables.register(spark)
    c = spark.createDataFrame([(1, 2, "a b c"), (1, 1, "d e"), (1, 3, "f"), (2, 1, None), (2, 2, "g " * 30)], "conv_id int, turn int, text string")
    got = spark.sql("SELECT * FROM windows_of(TABLE({c}), limit => 5)", c=c).collect()
    assert sorted((r.conv_id, r.window, r.first, r.last, r.tokens, r.text) for r in got) == [(1, 0, 1, 2, 5, "d e\na b c"), (1, 1, 3, 3, 1, "f"), (2, 0, 1, 1, 0, ""), (2, 1, 2, 2, 30, "g " * 30)]
    for query, message in (("SELECT * FROM chunks_of('x', 0, 1)", "limit"), ("SELECT * FROM sentences_of(12)", "string"), ("SELECT * FROM windows_of(TABLE(SELECT 1 AS x))", "misses")):
        with pytest.raises(Exception, match=message):
            spark.sql(query).collect()


def test_a_sample_takes_one_scan(spark, tmp_path):
    df = spark.range(5000).withColumn("sample_digest", F.lit("own")).withColumn("w", F.when(F.col("id") < 50, 1000.0).when(F.col("id") == 99, float("nan")).otherwise(0.001))
    df.repartition(7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    some = readers.sample_exact(df, 40, "id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.columns == df.columns and plan.count("FileScan") == 1 and "WindowGroupLimit" in plan
    want = df.orderBy(F.md5(F.concat(F.lit("42-"), F.col("id").cast("string")).cast("binary"))).limit(40)
    assert {r.id for r in some.collect()} == {r.id for r in want.collect()}
    heavy = [r.id for r in readers.sample_exact(df, 40, "id", weight="w").collect()]
    assert len(set(heavy)) == 40 and sum(i < 50 for i in heavy) >= 39
    assert readers.sample_exact(df.limit(3), 40, "id").count() == 3 and readers.sample_exact(df.where("id < 0"), 5, "id").count() == 0


def test_band_parameters(spark):
    assert duplicates.parameters(0.8, 128) == (duplicates.BANDS, duplicates.ROWS) == (9, 13)
    for t, hashes in ((0.5, 64), (0.7, 128), (0.9, 256)):
        bands, rows = duplicates.parameters(t, hashes)

        def error(b, r, t=t):
            at = [(i + 0.5) / 4000 for i in range(4000)]
            return sum((1 - (1 - s**r) ** b) if s < t else (1 - s**r) ** b for s in at)

        assert bands * rows <= hashes
        assert error(bands, rows) <= min(error(b, r) for b in range(max(1, bands - 2), bands + 3) for r in range(max(1, rows - 2), rows + 3) if b * r <= hashes) + 1e-3
    assert duplicates.parameters(0.8, 128, 0.1, 0.9)[1] < 13  # fewer misses, more bands
    for wrong in ((0, 128), (1.0, 128), (0.5, 0)):
        with pytest.raises(ValueError, match="threshold"):
            duplicates.parameters(*wrong)
    rows = [(str(i), f"{i} " + "one text in two variants that are close to each other " * 4) for i in range(2)] + [("9", "another one")]
    got = duplicates.lsh(spark.createDataFrame(rows, "review_id string, text string"), Workspace(spark, "t"), threshold=0.5, hashes=256)
    assert collections.Counter(r.is_duplicate for r in got.collect()) == {True: 2, False: 1}
