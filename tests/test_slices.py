"""Python stages hold a slice of an Arrow batch at a time, not all of its texts."""

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F

from corpusq.functions.chunk import chunk_stats, text_stats
from corpusq.functions.score import CLI, STAGED
from corpusq.functions.text import count_tokens
from corpusq.operators import duplicates
from corpusq.plans import pipeline
from corpusq.sources import sink


def test_chunk_statistics_take_texts_one_by_one(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "One two. Three four."), (3, "word " * 900)], "i int, t string").repartition(3)
    out = df.select("i", chunk_stats(F.col("t")).alias("s")).select("i", "s.*")
    assert ", 250" in out._jdf.queryExecution().executedPlan().toString()  # an Arrow function: no pandas copy of the batch
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    assert got[0] == got[1] == (0, 0.0, 0, 0, "empty") and got[2] == (1, 6.0, 6, 6, "too_short") and got[3][0] == 2
    assert df.limit(0).select(chunk_stats(F.col("t"))).count() == 0


def test_band_keys_take_slices(monkeypatch):
    sizes, banded = [], duplicates._banded
    texts = [f"text number {i}" for i in range(1000)]
    monkeypatch.setattr(duplicates, "_banded", lambda t, *a: sizes.append(len(t)) or banded(t, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(1000))), pa.array(texts)], ["id", "text"])
    out = pa.Table.from_batches(duplicates._keyed(9, 13)([batch]))
    assert max(sizes) <= duplicates.KEYED and out["id"].to_pylist() == batch.column(0).to_pylist()
    assert out["bands"].to_pylist() == [x.tolist() for x in banded(texts, 9, 13)]


def test_the_sink_takes_slices(tmp_path, monkeypatch):
    class Batch:
        def __init__(self, rows):
            self.rows, self.num_rows = rows, len(rows)

        def slice(self, at, n):
            return Batch(self.rows[at : at + n])

        def to_pylist(self):
            assert self.num_rows <= sink.BATCH_ROWS
            return self.rows

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(sink.TaskContext, "get", staticmethod(Task))
    done = sink.BatchWriter({"path": f"file://{tmp_path}", "batch_rows": "70"}).write([Batch([{"id": i} for i in range(250)]), Batch([])])
    assert (done.batches, done.rows) == (4, 250)


def test_scoring_lays_a_text_out_once(spark, tmp_path):
    seen = tmp_path / "seen"

    def counter(text):
        with seen.open("a") as f:
            f.write(text[:2] + " ")
        return len(text.split())

    texts = ["a0 " + "word " * 30, "b0 " + "word " * 30, "a0 " + "word " * 30, "  ", "c0 short", None, "d0 " + "\u00e9" * 90]
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, text string").selectExpr("review_id", "'u' AS user_id", "'b' AS business_id", "1D AS stars", "0L AS useful", "0L AS funny", "0L AS cool", "text", "'2020-01-01 00:00:00' AS date")
    for v in (replace(STAGED, duplicates="members"), CLI):
        seen.write_text("")
        got = pipeline.scored(raw, v, tokens=pipeline.Tokens.of(counter)).select("review_id", "token_count", "is_duplicate").collect()
        assert sorted(map(tuple, got)) == [("0", 31, v is not CLI), ("1", 31, False), ("2", 31, True)] or v is CLI
        assert sorted(seen.read_text().split()) == ["a0", "a0", "b0", "c0"] + ["d0"] * (v is CLI)
        assert r"\w+" not in pipeline.scored(raw, v)._jdf.queryExecution().optimizedPlan().toString()  # tokens of the pattern aren't counted in another place either


def test_tokens_beside_chunks_are_those_of_the_column(spark):
    texts = ["", " \u2003", "a\u0558b", "a\u24b6b \u200d \u0301 \u00aa\u00b2 \u4e00\u3001\U0001f600 x_1-2.5\u0085", None, "It's 12.5 %", "word " * 900]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(count_tokens(F.col("t")).alias("want"), text_stats(F.col("t")).alias("s"), chunk_stats(F.col("t")).alias("c")).collect()
    assert [r.s.token_count for r in rows] == [r.want for r in rows] and [tuple(r.s)[1:] for r in rows] == [tuple(r.c) for r in rows]
