"""Queries over the scored layer. The SQL ones run as they stand on any table with its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.score import tier_label, tier_rank
from corpusq.functions.text import from_json_list, matches, preview
from corpusq.plans.selection import quantiles
from corpusq.plans.workspace import Workspace

R1 = "floor(({}) * 10 + 0.5) / 10"
R0 = "floor(({}) + 0.5)"
R2 = "floor(({}) * 100 + 0.5) / 100"
ALL = "(SELECT count(*) FROM {gold})"


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"CAST({part} AS DOUBLE) * 100 / nullif({whole}, 0)"


READY = "count(*) FILTER (WHERE index_ready)"
DUP = "count(*) FILTER (WHERE is_duplicate)"
PII = "count(*) FILTER (WHERE has_pii)"
SCORE = R1.format("avg(index_readiness_score)")
TOKENS = f"CAST({R0.format('avg(token_count)')} AS DOUBLE)"

#: name -> SQL over {gold}
SQL = {
    "q01_overall": f"""SELECT count(*) AS total_reviews, {SCORE} AS avg_score, {TOKENS} AS avg_tokens, {R1.format(_pct(READY))} AS pct_index_ready,
        {R1.format(_pct(DUP))} AS pct_duplicates, {R1.format(_pct(PII))} AS pct_has_pii,
        {R1.format(_pct("count(*) FILTER (WHERE chunk_quality_flag = 'optimal')"))} AS pct_optimal_chunks FROM {{gold}}""",
    "q02_tiers": f"""SELECT recommendation, count(*) AS review_count, {R1.format(_pct('count(*)', ALL))} AS percentage, {SCORE} AS avg_score, {TOKENS} AS avg_tokens
        FROM {{gold}} GROUP BY recommendation ORDER BY CASE WHEN recommendation = 'index' THEN 1 WHEN recommendation = 'review' THEN 2 ELSE 3 END""",
    "q03a_city": f"""SELECT city, count(*) AS review_count, {SCORE} AS avg_score, {R1.format(_pct(READY))} AS pct_index_ready
        FROM (SELECT 'Phoenix' AS city, * FROM {{gold}} WHERE review_id LIKE '1%') AS t GROUP BY city LIMIT 10""",
    "q03b_prefixes": f"""SELECT substring(review_id, 1, 1) AS id_prefix, count(*) AS review_count, {SCORE} AS avg_score, {R1.format(_pct(READY))} AS pct_index_ready, {TOKENS} AS avg_tokens
        FROM {{gold}} GROUP BY 1 ORDER BY review_count DESC, id_prefix LIMIT 10""",
    "q04a_pii": f"""SELECT has_pii, count(*) AS review_count, {R1.format(_pct('count(*)', ALL))} AS percentage, {SCORE} AS avg_score, {TOKENS} AS avg_tokens
        FROM {{gold}} GROUP BY has_pii ORDER BY has_pii DESC""",
    "q04b_pii_union": f"""SELECT 'With PII' AS category, count(*) AS n, {SCORE} AS avg_score FROM {{gold}} WHERE has_pii = true
        UNION ALL SELECT 'Without PII' AS category, count(*) AS n, {SCORE} AS avg_score FROM {{gold}} WHERE has_pii = false""",
    "q05_duplicate_trend": f"""SELECT date_trunc('month', CAST(date AS TIMESTAMP)) AS month, count(*) AS total_reviews, {DUP} AS duplicate_count, {R2.format(_pct(DUP))} AS duplicate_rate, {SCORE} AS avg_score
        FROM {{gold}} GROUP BY 1 ORDER BY month DESC LIMIT 24""",
    "q06_chunk_quality": f"""SELECT chunk_quality_flag, count(*) AS review_count, {R1.format(_pct('count(*)', ALL))} AS percentage, {R1.format('avg(chunk_count)')} AS avg_chunks,
        CAST({R0.format('avg(avg_chunk_tokens)')} AS DOUBLE) AS avg_chunk_size, {SCORE} AS avg_score FROM {{gold}} GROUP BY chunk_quality_flag ORDER BY review_count DESC, chunk_quality_flag""",
    "q07_stars": f"""SELECT stars, count(*) AS review_count, {SCORE} AS avg_quality_score, {TOKENS} AS avg_tokens, {R1.format(_pct(READY))} AS pct_index_ready
        FROM {{gold}} GROUP BY stars ORDER BY stars""",
    "q08_problematic": """SELECT review_id, stars, token_count, chunk_quality_flag, has_pii, is_duplicate, index_readiness_score, substring(text, 1, 100) AS text_preview
        FROM {gold} WHERE index_ready = false ORDER BY index_readiness_score ASC, review_id LIMIT 20""",
    "q09_token_ranges": f"""SELECT token_range, count(*) AS review_count, {R1.format(_pct('count(*)', ALL))} AS percentage, {SCORE} AS avg_score, {R1.format(_pct(READY))} AS pct_index_ready
        FROM (SELECT CASE WHEN token_count < 50 THEN '0-50 (Very Short)' WHEN token_count < 100 THEN '50-100 (Short)' WHEN token_count < 200 THEN '100-200 (Medium)'
              WHEN token_count < 500 THEN '200-500 (Long)' ELSE '500+ (Very Long)' END AS token_range, * FROM {{gold}}) AS t GROUP BY token_range ORDER BY min(token_count)""",
    "q10_executive_summary": f"""SELECT count(*) AS total_reviews, {SCORE} AS avg_quality_score, count(*) FILTER (WHERE recommendation = 'index') AS ready_to_index,
        count(*) FILTER (WHERE recommendation = 'review') AS needs_review, count(*) FILTER (WHERE recommendation = 'reject') AS should_reject,
        {R1.format(_pct("count(*) FILTER (WHERE recommendation = 'index')"))} AS pct_ready, {PII} AS pii_violations, {DUP} AS duplicates,
        count(*) FILTER (WHERE chunk_quality_flag = 'optimal') AS optimal_chunks FROM {{gold}}""",
    "a08_flag_counts": "SELECT chunk_quality_flag, count(*) AS n FROM {gold} GROUP BY chunk_quality_flag ORDER BY n DESC, chunk_quality_flag",
    "a08_tier_counts": "SELECT recommendation, count(*) AS n FROM {gold} GROUP BY recommendation ORDER BY n DESC, recommendation",
    "a08_pii_counts": "SELECT CASE WHEN has_pii THEN 'Contains PII' ELSE 'No PII' END AS label, count(*) AS n FROM {gold} GROUP BY 1 ORDER BY n DESC, label",
    "a09_star_counts": "SELECT stars, count(*) AS n FROM {gold} GROUP BY stars ORDER BY stars",
    "a09_chunk_count_head": "SELECT chunk_count, count(*) AS n FROM {gold} GROUP BY chunk_count ORDER BY chunk_count LIMIT 10",
    "a11_score_histogram": """SELECT CASE WHEN index_readiness_score <= 30 THEN '[0, 30]' WHEN index_readiness_score <= 50 THEN '(30, 50]' WHEN index_readiness_score <= 70 THEN '(50, 70]'
        WHEN index_readiness_score <= 85 THEN '(70, 85]' ELSE '(85, 100]' END AS bin, count(*) AS n FROM {gold} GROUP BY 1""",
    "a12_issues": """SELECT count(*) FILTER (WHERE chunk_quality_flag <> 'optimal') AS chunk_issues, count(*) FILTER (WHERE is_duplicate) AS duplicate_issues, count(*) FILTER (WHERE has_pii) AS pii_issues,
        count(*) FILTER (WHERE chunk_quality_flag <> 'optimal' OR is_duplicate OR has_pii) AS multiple_issues FROM {gold} WHERE NOT index_ready""",
    "a14_component_scores": """SELECT count(*) FILTER (WHERE chunk_score = 100) AS chunk_100, count(*) FILTER (WHERE chunk_score = 30) AS chunk_30, count(*) FILTER (WHERE chunk_score = 0) AS chunk_0,
        count(*) FILTER (WHERE duplicate_score = 100) AS unique_100, count(*) FILTER (WHERE duplicate_score = 0) AS duplicate_0, count(*) FILTER (WHERE pii_score = 100) AS clean_100, count(*) FILTER (WHERE pii_score = 0) AS pii_0 FROM {gold}""",
    "a18_kpis": """SELECT count(*) AS total, coalesce(avg(index_readiness_score), 0) AS mean_score, coalesce(CAST(count(*) FILTER (WHERE is_duplicate) AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS duplicate_pct,
        coalesce(CAST(count(*) FILTER (WHERE has_pii) AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS pii_pct FROM {gold}""",
    "a19_score_bins": "SELECT CAST(floor(index_readiness_score / 5) * 5 AS DOUBLE) AS bin, count(*) AS n FROM {gold} GROUP BY 1 ORDER BY bin",
    "a20_median_score": "SELECT median(index_readiness_score) AS median_score FROM {gold}",
    "a21_score_by_flag": "SELECT chunk_quality_flag, avg(index_readiness_score) AS mean_score FROM {gold} GROUP BY chunk_quality_flag",
    "a22_kpi_deltas": """SELECT count(*) FILTER (WHERE recommendation = 'index') - count(*) AS total_delta, avg(index_readiness_score) FILTER (WHERE recommendation = 'index') - avg(index_readiness_score) AS score_delta,
        avg(CAST(has_pii AS INT)) FILTER (WHERE recommendation = 'index') * 100 - avg(CAST(has_pii AS INT)) * 100 AS pii_delta FROM {gold}""",
    "a25_rates": """SELECT avg(CAST(chunk_quality_flag = 'optimal' AS INT)) * 100 AS optimal_rate, avg(CAST(is_duplicate AS INT)) * 100 AS duplicate_rate, avg(CAST(has_pii AS INT)) * 100 AS pii_rate FROM {gold}""",
    "a28_batch_average": "SELECT coalesce(avg(index_readiness_score), 0) AS average_score, count(*) AS total_reviews FROM {gold}",
    "a30_cost_model": """SELECT 10000000 * (1 - ready) AS reviews_filtered, 10000000 * 0.25e0 / 1000 AS cost_without_filter, 10000000 * ready * 0.25e0 / 1000 AS cost_with_filter,
        10000000 * 0.25e0 / 1000 - 10000000 * ready * 0.25e0 / 1000 AS monthly_savings, (10000000 * 0.25e0 / 1000 - 10000000 * ready * 0.25e0 / 1000) * 12 AS annual_savings
        FROM (SELECT CAST(count(*) FILTER (WHERE index_ready) AS DOUBLE) / nullif(count(*), 0) AS ready FROM {gold}) AS t""",
    "a31_before_after": """SELECT count(*) AS all_reviews, count(*) FILTER (WHERE index_ready) AS ready_reviews, count(*) * 0.25e0 / 1000 AS cost_all, count(*) FILTER (WHERE index_ready) * 0.25e0 / 1000 AS cost_ready,
        count(*) FILTER (WHERE has_pii) AS pii_all, count(*) FILTER (WHERE has_pii AND index_ready) AS pii_ready, CAST(count(*) FILTER (WHERE has_pii) AS DOUBLE) * 100 / nullif(count(*), 0) AS pii_pct_all,
        CAST(count(*) FILTER (WHERE has_pii AND index_ready) AS DOUBLE) * 100 / nullif(count(*) FILTER (WHERE index_ready), 0) AS pii_pct_ready,
        avg(index_readiness_score) AS score_all, avg(index_readiness_score) FILTER (WHERE index_ready) AS score_ready FROM {gold}""",
    "a32_report_cost": "SELECT (count(*) - count(*) FILTER (WHERE index_ready)) * 0.25e0 / 1000 * 12 AS annual_saving FROM {gold}",
    "a34_token_ranges": """SELECT CASE WHEN token_count < 50 THEN 0 WHEN token_count < 100 THEN 50 WHEN token_count < 300 THEN 100 WHEN token_count <= 500 THEN 300 ELSE 501 END AS from_tokens, count(*) AS n FROM {gold} GROUP BY 1 ORDER BY 1""",
    "s10_export_ready": "SELECT review_id, text, stars, date, index_readiness_score FROM {gold} WHERE index_ready",
    "s11_export_pii": "SELECT review_id, text, pii_types, index_readiness_score FROM {gold} WHERE has_pii",
    "s13_report_numbers": """SELECT recommendation, count(*) AS n, CAST(count(*) AS DOUBLE) * 100 / nullif((SELECT count(*) FROM {gold}), 0) AS pct, avg(index_readiness_score) AS mean_score FROM {gold} GROUP BY recommendation""",
    "o07_star_values": "SELECT DISTINCT stars FROM {gold} ORDER BY stars",
    "o07_date_range": "SELECT CAST(min(CAST(date AS TIMESTAMP)) AS DATE) AS first_day, CAST(max(CAST(date AS TIMESTAMP)) AS DATE) AS last_day FROM {gold}",
    "f09_filtered": """SELECT review_id, stars, recommendation, date FROM {gold} WHERE CAST(CAST(date AS TIMESTAMP) AS DATE) BETWEEN CAST('2020-03-01' AS DATE) AND CAST('2020-09-30' AS DATE)
        AND stars IN (4, 5) AND recommendation = 'index'""",
}


def run_sql(gold: DataFrame, name: str) -> DataFrame:
    return gold.sparkSession.sql(SQL[name], gold=gold)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, sample standard deviation, extremes and exact interpolated quartiles, the latter by selection in a few scans."""
    found = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        q = [F.lit(v).cast("double") for v in found[c]]
        parts.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(x).alias("max")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nulls: from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in columns])
    return df.agg(pairs.alias("a")).select(F.explode("a").alias("r")).select("r.*")


def text_lengths(df: DataFrame) -> DataFrame:
    """min_chars, max_chars, mean_chars, median_chars; texts are read once, for a table of their lengths."""
    df = Workspace(df.sparkSession, "lengths").save("n", df.select(F.length("text").alias("n")))
    n = F.col("n")
    median = quantiles(df, {"n": n}, [0.5])["n"][0]
    return df.agg(F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.avg(n).alias("mean_chars"), F.lit(median).cast("double").alias("median_chars"))


def median_score(gold: DataFrame) -> DataFrame:
    median = quantiles(gold, {"s": F.col("index_readiness_score")}, [0.5])["s"][0]
    return gold.sparkSession.range(1).select(F.lit(median).cast("double").alias("median_score"))


def pii_type_counts(gold: DataFrame) -> DataFrame:
    """pii_type, n, most frequent first."""
    return gold.select(F.explode(from_json_list(F.col("pii_types"))).alias("pii_type")).groupBy("pii_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pii_type")


def labels(gold: DataFrame) -> DataFrame:
    """review_id with the display labels of its tier and of has_pii."""
    return gold.select("review_id", tier_label(F.col("recommendation")).alias("tier_label"), F.when(F.col("has_pii"), "Contains PII").otherwise("No PII").alias("pii_label"))


def filtered(gold: DataFrame, first_day: str | None = None, last_day: str | None = None, stars: Sequence[float] = (), tier: str | None = None) -> DataFrame:
    """Rows within the days (both included), of the stars and of the tier; what isn't given doesn't filter."""
    day = F.to_date(F.col("date").cast("timestamp"))
    if first_day:
        gold = gold.where(day >= F.lit(first_day).cast("date"))
    if last_day:
        gold = gold.where(day <= F.lit(last_day).cast("date"))
    if stars:
        gold = gold.where(F.col("stars").isin(*stars))
    return gold.where(F.col("recommendation") == tier) if tier else gold


def search(gold: DataFrame, query: str, literal: bool = False) -> DataFrame:
    return gold.where(matches(query, F.col("text"), F.col("review_id"), literal=literal))


def search_view(hits: DataFrame, n: int = 50) -> DataFrame:
    """The n best hits with a preview."""
    return hits.orderBy(F.desc("index_readiness_score"), "review_id").limit(n).select("review_id", "stars", "index_readiness_score", "recommendation", preview(F.col("text"), 100, "...").alias("text_preview"))


def top_per_tier(gold: DataFrame, n: int = 2) -> DataFrame:
    """The first n rows of each tier by review_id, from one scan; the limit applies per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("recommendation").orderBy("review_id"))
    rows = gold.select("recommendation", "review_id", "index_readiness_score").withColumn("place", place).where(F.col("place") <= n).drop("place")
    return rows.orderBy(tier_rank(F.col("recommendation")), "review_id")


def distinct_clusters(gold: DataFrame) -> DataFrame:
    """Number of duplicate clusters, flagged rows, and their quotient."""
    n = F.count_distinct(F.when(F.col("duplicate_cluster_id") != -1, F.col("duplicate_cluster_id")))
    rows = F.count_if("is_duplicate")
    return gold.agg(n.alias("clusters"), rows.alias("duplicates"), F.coalesce(F.try_divide(rows, n), F.lit(0.0)).alias("mean_size"))


def nearest(vectors: DataFrame, query: Sequence[float], n: int = 10, where: Column | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The n most similar vectors by cosine among the rows that match, as a top-k."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col(column), F.col(column).cast("array<double>")) * dot(q, q))
    return rows.select(key, F.try_divide(dot(F.col(column), q), norm).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), key).limit(n)


def service_cost(gold: DataFrame, millions: float = 10, per_thousand: float = 0.25) -> DataFrame:
    """The cost model with its parameters."""
    ready = F.try_divide(F.count_if("index_ready").cast("double"), F.count(F.lit(1)))
    total = millions * 1e6
    return gold.agg(ready.alias("ready")).select((F.lit(total) * (1 - F.col("ready"))).alias("reviews_filtered"), (F.lit(total * per_thousand / 1000) * (1 - F.col("ready"))).alias("monthly_savings"), (F.lit(total * per_thousand / 1000 * 12) * (1 - F.col("ready"))).alias("annual_savings"))

