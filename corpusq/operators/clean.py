"""Cleaning: null and blank texts, short texts, texts that aren't mostly ASCII."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.score import STAGED, Variant
from corpusq.functions.text import count_tokens, is_blank, is_mostly_ascii, strip
from corpusq.plans.once import free_name, once, spread

BATCH_ROWS = 100


def _steps(v: Variant) -> list[tuple[str, Column]]:
    text = strip(F.col("text")) if v.strip else F.col("text")
    steps = [("not_null", F.col("text").isNotNull()), ("not_blank", ~is_blank(F.col("text")))]
    if v.min_tokens:
        steps.append(("long_enough", F.coalesce(count_tokens(text) >= v.min_tokens, F.lit(False))))
    if v.ascii_share is not None:
        steps.append(("mostly_ascii", is_mostly_ascii(text, v.ascii_share)))
    return steps


def stripped(raw: DataFrame, v: Variant = STAGED) -> DataFrame:
    """The rows whose text isn't null or blank, stripped if the variant has it so."""
    df = raw.where("text is not null")
    text = strip(F.col("text"))
    return once(df, text=text).where("text <> ''") if v.strip else df.where(text != "")


def readable(raw: DataFrame, v: Variant = STAGED) -> DataFrame:
    """The rows that pass all steps but the one that counts tokens."""
    df = stripped(raw, v)
    return df if v.ascii_share is None else df.where(is_mostly_ascii(F.col("text"), v.ascii_share))


def long_enough(df: DataFrame, v: Variant) -> DataFrame:
    """The rows whose token_count is that of the variant at least."""
    return df.where(F.col("token_count") >= v.min_tokens) if v.min_tokens else df


def clean(raw: DataFrame, v: Variant = STAGED, counter: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """The rows that pass all steps, with token_count by any counter."""
    return long_enough(once(readable(raw, v), token_count=counter(F.col("text"))), v)


def funnel(raw: DataFrame, v: Variant = STAGED) -> DataFrame:
    """step, n, removed, pct_removed, pct_retained: the count after each step, in one scan."""
    steps = _steps(v)
    passed, totals = F.lit(True), [F.count(F.lit(1)).alias("0")]
    for i, (_, p) in enumerate(steps, 1):
        passed = passed & p
        totals.append(F.count_if(passed).alias(str(i)))
    one = raw.agg(*totals)
    names = ["input", *[n for n, _ in steps]]
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(str(i)).alias("n"), F.col(str(max(i - 1, 0))).alias("before"), F.col("0").alias("all")) for i, n in enumerate(names)])
    df = one.select(F.explode(rows).alias("r")).select("r.*")
    pct = lambda a, b: F.when(b > 0, F.round(a * F.lit(100.0) / b, 4))
    return df.select("step_no", "step", "n", (F.col("before") - F.col("n")).alias("removed"), pct(F.col("before") - F.col("n"), F.col("before")).alias("pct_removed"), pct(F.col("n"), F.col("all")).alias("pct_retained"))


def validate_requests(rows: DataFrame) -> DataFrame:
    """rows (text, stars) with error, null if the request is valid; see `validate_batches` for batches."""
    n = F.length("text")
    error = (
        F.when(F.col("text").isNull(), "text is missing")
        .when(n < 10, "text is shorter than 10 characters")
        .when(n > 10000, "text is longer than 10000 characters")
        .when(is_blank(F.col("text")), "text is blank")
        .when((F.col("stars") < 1) | (F.col("stars") > 5), "stars are not within 1 and 5")
    )
    return rows.withColumn("error", error)


def validate_batches(rows: DataFrame, batch: str, most: int = BATCH_ROWS) -> DataFrame:
    """As `validate_requests` for requests that come in batches; an invalid row or more than `most` rows fail the whole batch.

    error is a row's own, or what its batch fails for. Sizes and errors are combined per batch before their shuffle.
    """
    own = validate_requests(rows)
    name, n, bad = (free_name(own, x) for x in ("batch_of", "rows_of_batch", "errors_of_batch"))
    of = own.groupBy(F.col(batch).alias(name)).agg(F.count(F.lit(1)).alias(n), F.count("error").alias(bad))
    out = own.join(spread(of), own[batch].eqNullSafe(F.col(name)), "left")
    error = F.when(F.col(n) > most, f"the batch has more than {most} rows").when(F.col("error").isNotNull(), F.col("error")).when(F.col(bad) > 0, "another row of the batch is invalid")
    return out.withColumn("error", error).drop(name, n, bad)
