"""The registered queries of the training data problems (p7 to p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.runtime import table
from millrace.llm import mixing, percentiles, subjects, tokens

_GROUPS = ["project_id", "status"]


def _doubles(df: DataFrame) -> DataFrame:
    """The exact decimals as the doubles next to them."""
    return df.withColumns({c: F.col(c).cast("double") for c in map(percentiles.percentile_name, percentiles.PERCENTILES)})


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all days, from the days' states."""
    states = percentiles.merge_states(percentiles.duration_states(table(spark, d, "job_executions")), _GROUPS)
    return _doubles(percentiles.percentiles(states, _GROUPS))


def p7_daily(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of single days."""
    states = percentiles.duration_states(table(spark, d, "job_executions"))
    return _doubles(percentiles.percentiles(states, [*_GROUPS, "day"]))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text")
    return mixing.mix(mixing.materialise(sizes), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _mix_chars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same mix by characters, which SQL can count."""
    sizes = table(spark, d, "documents").select("doc_id", "source", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return mixing.mix(sizes, table(spark, d, "mix_targets"), size="n_chars")


def p9_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    return _mix_chars(spark, d)[0]


def p9_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    return _mix_chars(spark, d)[1].select("source", "target_share", "max_repeats", F.col("source_tokens").alias("source_chars"), F.col("wanted_tokens").alias("wanted_chars"), F.col("tokens").alias("chars"), "documents", "uses", "share_of_total", "share_of_mix")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents, and the sum of posteriors."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("posterior"), 3).alias("expected"))


def queries() -> dict:
    return {f.__name__: f for f in (p7_percentiles, p7_daily, p8_ids, p9_mix, p9_shares, p9_mix_chars, p9_shares_chars, p10_found, p10_makeup)}


def oracle_sql() -> dict[str, str]:
    def p7(groups: str) -> str:
        names = ", ".join(groups.split())
        picks = ", ".join(f"sum(CASE rn WHEN (n - 1) * {p} // 100 THEN v * (100 - (n - 1) * {p} % 100) WHEN (n - 1) * {p} // 100 + 1 THEN v * ((n - 1) * {p} % 100) ELSE 0 END) / 100 AS {percentiles.percentile_name(p)}" for p in percentiles.PERCENTILES)
        return f"""
WITH x AS (SELECT project_id, status, id, min(duration_ms) v, min(CAST(created_at AS DATE)) AS day FROM job_executions WHERE duration_ms >= 0 GROUP BY ALL),
y AS (SELECT {names}, v, row_number() OVER (PARTITION BY {names} ORDER BY v) - 1 rn, count(*) OVER (PARTITION BY {names}) n FROM x)
SELECT {names}, count(*) n_rows, {picks}, 0.0::DOUBLE max_error FROM y GROUP BY {names}"""

    p9 = """
WITH s AS (SELECT doc_id, source, coalesce(n_chars, 0) n, md5('17|' || doc_id) h FROM documents), t AS (SELECT coalesce(sum(n), 0) total FROM s),
p AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) upto, sum(n) OVER (PARTITION BY source) size FROM s),
w AS (SELECT source, target_share, max_repeats, CAST(round(target_share * total) AS BIGINT) budget, greatest(max_repeats, 0) m, total FROM mix_targets, t),
e AS (SELECT p.*, budget, m, CASE WHEN size > 0 THEN least(m, budget // greatest(size, 1)) ELSE least(m, 1) END epochs FROM p JOIN w USING (source)),
x AS (SELECT *, budget - epochs * size rest FROM e),
u AS (SELECT *, CAST(epochs + CASE WHEN epochs < m AND rest > 0 AND 2 * (upto - rest) <= n AND upto - n < rest THEN 1 ELSE 0 END AS BIGINT) times FROM x)
"""
    shares = """, r AS (SELECT source, sum(n * times) chars, count(*) FILTER (times > 0) documents, sum(times) uses, max(size) size FROM u GROUP BY 1),
z AS (SELECT w.source, target_share, max_repeats, CAST(coalesce(size, 0) AS BIGINT) source_chars, budget wanted_chars, CAST(coalesce(chars, 0) AS BIGINT) chars, coalesce(documents, 0) documents, CAST(coalesce(uses, 0) AS BIGINT) uses, total FROM w LEFT JOIN r USING (source))
SELECT * EXCLUDE (total), chars / total share_of_total, chars / sum(chars) OVER () share_of_mix FROM z"""
    return {"p7_percentiles": p7("project_id status"), "p7_daily": p7("project_id status day"), "p9_mix_chars": p9 + "SELECT doc_id, source, n AS n_chars, times FROM u WHERE times > 0", "p9_shares_chars": p9 + shares}
