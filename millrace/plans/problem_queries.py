"""The registered queries of the general data problems (p1 to p6) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.runtime import iso_millis, shared_dir, table
from millrace.operators import badrows, drift, intervals, nested, references, skew

LONGEST_GAP_DAYS = 7
HEAVY_SHARE = 0.02
ORDER_FIELDS = [
    badrows.Field("order_id", "bigint", badrows.number_up_to(2**63 - 1, 1), optional=False),
    badrows.Field("customer_id"),
    badrows.Field("product_id"),
    badrows.Field("quantity", "int", badrows.signed_up_to(32)),
    badrows.Field("unit_price", "double", badrows.DECIMAL),
    badrows.Field("status"),
]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = intervals.merged_intervals(table(spark, d, "job_executions"), "project_id", "started_at", "completed_at")
    short = F.col("to_time") <= F.col("from_time") + F.expr(f"INTERVAL '{LONGEST_GAP_DAYS}' DAY")
    return both.where((F.col("kind") == "period") | short).select(F.col("entity").alias("project_id"), F.col("kind").alias("part_kind"), iso_millis(F.col("from_time")).alias("from_time"), iso_millis(F.col("to_time")).alias("to_time"))


def p1_busy_time(spark: SparkSession, d: str) -> DataFrame:
    """Per project: periods, gaps of any length, busy and idle seconds."""
    both = intervals.merged_intervals(table(spark, d, "job_executions"), "project_id", "started_at", "completed_at")
    ms = F.timestamp_diff("MILLISECOND", F.col("from_time"), F.col("to_time"))
    period = F.col("kind") == "period"
    return both.groupBy(F.col("entity").alias("project_id")).agg(F.count_if(period).alias("periods"), F.count_if(~period).alias("gaps"), F.sum(F.when(period, ms).otherwise(0)).alias("busy_ms"), F.sum(F.when(period, 0).otherwise(ms)).alias("idle_ms"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.definition_links(table(spark, d, "project_files"), table(spark, d, "yaml_definitions"))


def _nested(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.definition_tables(table(spark, d, "project_files"), table(spark, d, "yaml_definitions"))[kind]

    return query


def _order_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return badrows.split_lines(table(spark, d, "raw_order_lines").where("NOT line_no <=> 1"), "raw_line", ORDER_FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _order_lines(spark, d)[1].select("raw_id", "reason")


def p3_good(spark: SparkSession, d: str) -> DataFrame:
    return _order_lines(spark, d)[0].select("raw_id", *[f.name for f in ORDER_FIELDS])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    links = [("customer_id", "customers", table(spark, d, "customers"), "cust_id", "created_at", "deleted_at"), ("product_id", "products", table(spark, d, "products"), "prod_id", "created_at", "deleted_at")]
    return references.orphan_references(table(spark, d, "sales_orders"), "order_id", "ordered_at", links)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).withColumnRenamed("ref_id", "order_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "ym", "reason").agg(F.count(F.lit(1)).alias("orders"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.feed_changes(table(spark, d, "project_files"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_fields(table(spark, d, "project_files"))


def p5_united(spark: SparkSession, d: str) -> DataFrame:
    """Orders as three systems wrote them, in files of their own: one field renamed, two retyped, one gone, one
    added; read as one table."""
    o = table(spark, d, "sales_orders")
    year = F.coalesce(F.year("ordered_at"), F.lit(0))
    folder = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    o.where(year <= 2022).select("order_id", "customer_id", "product_id", "quantity", "unit_price", "status").write.parquet(f"{folder}/1")
    o.where(year == 2023).select("order_id", F.col("customer_id").alias("client_id"), "product_id", F.col("quantity").cast("bigint").alias("quantity"), "unit_price").write.parquet(f"{folder}/2")
    o.where(year >= 2024).select("order_id", F.col("customer_id").alias("client_id"), "product_id", "quantity", F.floor("unit_price").cast("int").alias("unit_price"), "loaded_at").write.parquet(f"{folder}/3")
    united, _ = drift.unite(drift.read_versions(spark, [f"{folder}/{i}" for i in (1, 2, 3)]))
    return united.drop("version")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_totals(table(spark, d, "sales_orders"), ["customer_id", "product_id"], "order_id", "quantity", "unit_price")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_totals(spark, d), HEAVY_SHARE)


def p6_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d)


def queries() -> dict:
    named = [p1_found, p1_busy_time, p2_found, p3_found, p3_good, p4_found, p4_report, p5_found, p5_unified, p5_united, p6_found, p6_per_key]
    return {f.__name__: f for f in named} | {f"p2_{k}": _nested(k) for k in nested.TABLES}


_P1 = """
WITH x AS (SELECT DISTINCT project_id, started_at s, completed_at e FROM job_executions WHERE completed_at > started_at),
y AS (SELECT *, max(e) OVER (PARTITION BY project_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM x),
z AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM y),
p AS (SELECT project_id, k, min(s) f, max(e) t FROM z GROUP BY ALL),
g AS (SELECT project_id, t f, lead(f) OVER (PARTITION BY project_id ORDER BY k) t FROM p),
a AS (SELECT project_id, 'period' part_kind, f, t FROM p UNION ALL SELECT project_id, 'gap', f, t FROM g WHERE t IS NOT NULL)
"""
_F = r'"(?:[^"]|"")*"|[^",]*'
_P3 = rf"""
WITH r AS (SELECT raw_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') l FROM raw_order_lines WHERE line_no IS DISTINCT FROM 1),
q AS (SELECT raw_id, l, regexp_full_match(l, '(?s)(?:{_F})(?:,(?:{_F}))*') ok, regexp_full_match(l, '(?s)(?:{_F})(?:,(?:{_F})){{5}}') six,
  [CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE trim(x, chr(32) || chr(9)) END FOR x IN
   [{', '.join(f"regexp_extract(l, '(?s)^({_F}),({_F}),({_F}),({_F}),({_F}),({_F})$', {i})" for i in range(1, 7))}]] v FROM r),
w AS (SELECT *, CASE WHEN NOT ok THEN 'broken_quoting' WHEN NOT six THEN 'column_count'
  WHEN NOT regexp_full_match(v[1], '[0-9]+') OR try_cast(v[1] AS HUGEINT) IS NULL OR try_cast(v[1] AS HUGEINT) NOT BETWEEN 1 AND 9223372036854775807 THEN 'bad_order_id'
  WHEN v[4] <> '' AND (NOT regexp_full_match(v[4], '-?[0-9]+') OR try_cast(v[4] AS INTEGER) IS NULL) THEN 'bad_quantity'
  WHEN v[5] <> '' AND NOT regexp_full_match(v[5], '-?[0-9]+([.][0-9]+)?') THEN 'bad_unit_price' END reason FROM q)
"""
_P4 = """
WITH o AS (SELECT order_id, 'customers' ref_table, upper(trim(customer_id)) k, ordered_at t FROM sales_orders UNION ALL SELECT order_id, 'products', upper(trim(product_id)), ordered_at FROM sales_orders),
r AS (SELECT DISTINCT * FROM o WHERE k IS NOT NULL AND t IS NOT NULL),
c AS (SELECT 'customers' ref_table, upper(trim(cust_id)) k, created_at, deleted_at FROM customers UNION SELECT 'products', upper(trim(prod_id)), created_at, deleted_at FROM products),
j AS (SELECT r.order_id, r.ref_table, r.k, r.t, count(c.k) n, count(*) FILTER (c.created_at <= r.t) older, count(*) FILTER (c.created_at <= r.t AND (c.deleted_at IS NULL OR c.deleted_at > r.t)) live
  FROM r LEFT JOIN c ON r.ref_table = c.ref_table AND r.k = c.k GROUP BY ALL),
f AS (SELECT DISTINCT order_id, ref_table, CASE WHEN n = 0 THEN 'missing' WHEN older = 0 THEN 'late' ELSE 'deleted' END reason, strftime(t, '%Y-%m') ym FROM j WHERE live = 0)
"""
_P6 = """
WITH o AS (SELECT 'customer_id' field_name, upper(trim(customer_id)) key_value, quantity, unit_price FROM sales_orders UNION ALL SELECT 'product_id', upper(trim(product_id)), quantity, unit_price FROM sales_orders)
"""


def oracle_sql() -> dict[str, str]:
    ms = "strftime({0}, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(CAST(date_part('millisecond', {0}) AS INTEGER) % 1000 AS VARCHAR), 3, '0')"
    return {
        "p1_found": _P1 + f"SELECT project_id, part_kind, {ms.format('f')} from_time, {ms.format('t')} to_time FROM a WHERE part_kind = 'period' OR t <= f + INTERVAL {LONGEST_GAP_DAYS} DAY",
        "p1_busy_time": _P1 + "SELECT project_id, count(*) FILTER (part_kind = 'period') periods, count(*) FILTER (part_kind = 'gap') gaps, CAST(coalesce(sum(date_diff('millisecond', f, t)) FILTER (part_kind = 'period'), 0) AS BIGINT) busy_ms, CAST(coalesce(sum(date_diff('millisecond', f, t)) FILTER (part_kind = 'gap'), 0) AS BIGINT) idle_ms FROM a GROUP BY 1",
        "p3_found": _P3 + "SELECT raw_id, reason FROM w WHERE reason IS NOT NULL",
        "p3_good": _P3 + "SELECT raw_id, CAST(v[1] AS BIGINT) order_id, nullif(v[2], '') customer_id, nullif(v[3], '') product_id, try_cast(nullif(v[4], '') AS INTEGER) quantity, try_cast(nullif(v[5], '') AS DOUBLE) unit_price, nullif(v[6], '') status FROM w WHERE reason IS NULL",
        "p4_found": _P4 + "SELECT * FROM f",
        "p4_report": _P4 + "SELECT ref_table, ym, reason, count(*) orders FROM f GROUP BY ALL",
        "p5_united": """SELECT order_id, customer_id AS client_id, product_id, CAST(quantity AS BIGINT) AS quantity, CASE WHEN year(ordered_at) >= 2024 THEN floor(unit_price) ELSE unit_price END AS unit_price,
  CASE WHEN coalesce(year(ordered_at), 0) <= 2022 THEN status END AS status, CASE WHEN year(ordered_at) >= 2024 THEN loaded_at END AS loaded_at FROM sales_orders""",
        "p6_found": _P6 + f"SELECT field_name, key_value FROM o WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM sales_orders)",
        "p6_per_key": _P6 + "SELECT field_name, key_value, count(*) n_rows, CAST(sum(quantity) AS BIGINT) quantity, CAST(sum(quantity * CAST(unit_price AS DECIMAL(18,6))) AS DOUBLE) revenue FROM o GROUP BY ALL",
    }
