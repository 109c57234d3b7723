"""Quantiles by selection against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import reports
from corpusq.plans import selection
from corpusq.plans.selection import quantiles

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_a_million_different_values(spark):
    df = spark.range(1_000_003).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)).cast("double") ** 3).alias("x"))
    got = quantiles(df, {"x": F.col("x")}, AT)["x"]
    want = np.quantile(np.arange(1_000_003, dtype=float) ** 3, AT)
    assert np.allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("buckets", [16, 1024])
def test_equal_to_percentile(spark, monkeypatch, buckets):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    rng = random.Random(3)
    kinds = {"few": lambda: float(rng.choice([1, 2, 2, 2, 9])), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-200, 200), "one": lambda: 7.0, "gaps": lambda: rng.choice([None, float("nan"), rng.random()]), "none": lambda: None, "huge": lambda: rng.choice([-1.7e308, 1.7e308, 0.0])}
    rows = [tuple(f() for f in kinds.values()) for _ in range(150)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in kinds))
    got = quantiles(df, {k: F.col(k) for k in kinds}, AT)
    for i, k in enumerate(kinds):
        real = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        if not real:
            assert got[k] == [None] * len(AT)
            continue
        for p, g in zip(AT, got[k]):
            x = p * (len(real) - 1)
            a, b = real[int(np.floor(x))], real[int(np.ceil(x))]
            assert g == (a if a == b else (np.ceil(x) - x) * a + (x - np.floor(x)) * b), (k, p)


def test_reports_have_no_percentile_and_bad_values(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(10)], "x double, y long")
    told = reports.describe(df, ["x", "y"])
    assert "percentile" not in told._jdf.queryExecution().toString().lower()
    assert [(r.p25, r.p50, r.p75) for r in told.collect()] == [(2.25, 4.5, 6.75)] * 2
    assert reports.text_lengths(spark.createDataFrame([("ab",), (None,), ("abcd",)], "text string")).first().median_chars == 3.0
    assert reports.text_lengths(spark.createDataFrame([], "text string")).first().median_chars is None
    with pytest.raises(ValueError, match="infinite"):
        quantiles(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), {"x": F.col("x")}, [0.5])
