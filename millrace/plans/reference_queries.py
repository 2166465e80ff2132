"""One registered query for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace.plans.compiler  # noqa: F401  registers the steps
from millrace.core.runtime import table
from millrace.frame import Frame
from millrace.plans.compiler import build
from millrace.plans.model import load_transformation
from millrace.registry import STEPS, Context, Params

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _step(spark: SparkSession, kind: str, ins: list[Frame] | Frame, /, **params) -> Frame:
    out = STEPS[kind](ins if isinstance(ins, list) else [ins], Params({k.rstrip("_").replace("__", "."): v for k, v in params.items()}), Context(spark))
    return next(iter(out.values())) if isinstance(out, dict) and len(out) == 1 else out


def _frame(spark: SparkSession, d: str, name: str, columns: str, order: str | None = None, text: bool = False) -> Frame:
    names = columns.split()
    return Frame.of(table(spark, d, name).select(*names), order.split() if order else None, text)


def _single(name: str, kind: str, source: str, fields: str, sql: str, /, order: str | None = None, out: str | None = None, **params) -> None:
    """A query of one step over one table."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        f = _step(spark, kind, _frame(spark, d, source, fields, order), **params)
        return f.to_df(out.split() if out else None)

    _QUERIES[name], _SQL[name] = query, sql


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _simple() -> None:
    s = _single
    s("constant", "Constant", "nation", "n_nationkey n_name", "SELECT n_nationkey, n_name, 'x' AS a, '7' AS b FROM nation", out="n_nationkey n_name a b", value__0="x", value__1="7")
    s("set_value_constant", "SetValueConstant", "customer", "c_custkey c_mktsegment", "SELECT c_custkey, 'ALL' AS c_mktsegment FROM customer", column="1", value="ALL")
    s("set_value_field", "SetValueField", "nation", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation", sourceColumn="0", targetColumn="2")
    s("field_splitter", "FieldSplitter", "part", "p_partkey p_name", "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, nullif(split_part(p_name, ' ', 2), '') AS b FROM part", column="1", separator=" ", outputCount="2", out="p_partkey a b")
    s("split_field_to_rows", "SplitFieldToRows3", "part", "p_partkey p_name", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part", column="1", separator=" ")
    s("clone_row", "CloneRow", "orders", "o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders, range(3)", cloneCount="3")
    for op, sql in {"trim": "trim(p_name)", "ltrim": "ltrim(p_name)", "rtrim": "rtrim(p_name)", "upper": "upper(p_name)", "lower": "lower(p_name)", "initcap": "array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(p_name, ' ')], ' ')"}.items():
        s(f"string_{op}", "StringOperations", "part", "p_partkey p_name", f"SELECT p_partkey, {sql} AS p_name FROM part", column="1", operation=op)
    s("replace_string_literal", "ReplaceString", "part", "p_partkey p_type", "SELECT p_partkey, replace(p_type, 'A', '<a>') AS p_type FROM part", column="1", search="A", replacement="<a>")
    s("replace_string_regex", "ReplaceString", "part", "p_partkey p_type", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]+', '_', 'g') AS p_type FROM part", column="1", search="[AEIOU]+", replacement="_", regex="true")
    s("string_cut", "StringCut", "customer", "c_custkey c_name", "SELECT c_custkey, substr(c_name, 4, 5) AS c_name FROM customer", column="1", fromIndex="3", toIndex="8")
    s("regex_eval", "RegexEval", "events", "event_id event_type", "SELECT event_id, event_type, nullif(regexp_extract(event_type, '^(c)(.*)$', 1), '') AS a, nullif(regexp_extract(event_type, '^(c)(.*)$', 2), '') AS b FROM events", column="1", pattern="^(c)(.*)$", out="event_id event_type a b")
    s("value_mapper", "ValueMapper", "orders", "o_orderkey o_orderstatus", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS o_orderstatus FROM orders", column="1", from__0="F", to__0="final", from__1="O", to__1="open", defaultValue="other")
    s("null_if", "NullIf", "orders", "o_orderkey o_orderstatus", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders", column="1", value="F")
    s("if_null", "IfNull", "sales_orders", "order_id customer_id product_id", "SELECT order_id, coalesce(customer_id, 'none') AS customer_id, product_id FROM sales_orders", column="1", defaultValue="none")
    for op, sign in {"ADD": "+", "SUBTRACT": "-", "MULTIPLY": "*"}.items():
        s(f"calculator_{op.lower()}", "Calculator", "lineitem", "l_orderkey l_quantity l_extendedprice", f"SELECT l_orderkey, l_quantity, l_extendedprice, CAST(l_quantity {sign} l_extendedprice AS DOUBLE) AS x FROM lineitem", colA="1", colB="2", operation=op, fieldName="x")
    s("calculator_divide", "Calculator", "lineitem", "l_orderkey l_quantity l_linenumber", "SELECT l_orderkey, l_quantity, l_linenumber, l_quantity / CAST(l_linenumber AS DOUBLE) AS x FROM lineitem", colA="1", colB="2", operation="DIVIDE", fieldName="x")
    s("calculator_modulo", "Calculator", "lineitem", "l_orderkey l_quantity", "SELECT l_orderkey, l_quantity, l_quantity % 7.0::DOUBLE AS x FROM lineitem", colA="1", valueB="7", operation="MODULO", fieldName="x")
    s("formula_if", "Formula", "lineitem", "l_orderkey l_quantity", "SELECT l_orderkey, l_quantity, CASE WHEN l_quantity >= 25 THEN 'big' ELSE 'small' END AS size FROM lineitem", formulaString='IF([l_quantity]>=25;"big";"small")', fieldName="size")
    s("formula_concatenate", "Formula", "nation", "n_nationkey n_name", "SELECT n_nationkey, n_name, 'nation: ' || n_name AS label FROM nation", formulaString='CONCATENATE("nation: ";[n_name];[none])', fieldName="label")
    s("checksum_md5", "CheckSum", "customer", "c_custkey c_name c_mktsegment", "SELECT c_custkey, c_name, c_mktsegment, md5(c_name || c_mktsegment) AS h FROM customer", columns="1,2", out="c_custkey c_name c_mktsegment h")
    s("checksum_sha256", "CheckSum", "customer", "c_custkey c_name", "SELECT c_custkey, c_name, sha256(c_name) AS h FROM customer", columns="1", algorithm="SHA-256", out="c_custkey c_name h")
    s("validator", "Validator", "part", "p_partkey p_name", "SELECT p_partkey, p_name, CAST(regexp_full_match(p_name, '[a-z ]+') AND length(p_name) BETWEEN 8 AND 14 AS VARCHAR) AS ok FROM part", column="1", pattern="[a-z ]+", minLength="8", maxLength="14", out="p_partkey p_name ok")
    s("number_range", "NumberRange", "lineitem", "l_orderkey l_quantity", "SELECT l_orderkey, l_quantity, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 'low' WHEN l_quantity BETWEEN 10 AND 30 THEN 'mid' ELSE 'high' END AS band FROM lineitem", column="1", lowerBound__0="0", upperBound__0="10", label__0="low", lowerBound__1="10", upperBound__1="30", label__1="mid", defaultLabel="high", out="l_orderkey l_quantity band")
    s("dummy", "Dummy", "orders", "o_orderkey o_custkey", "SELECT o_orderkey, o_custkey FROM orders")
    s("get_variable", "GetVariable", "orders", "o_orderkey", "SELECT o_orderkey, 'fallback' AS v FROM orders", variableName="NO_SUCH_VARIABLE_HERE", defaultValue="fallback", out="o_orderkey v")
    # filters
    s("string_initcap_padded", "StringOperations", "raw_order_lines", "raw_id raw_line", r"SELECT raw_id, regexp_replace(array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(regexp_replace(trim(regexp_replace(raw_line, '[ \t\n\v\f\r]+', ' ', 'g'), ' '), ' +', ' ', 'g'), ' ')], ' '), ' +', ' ', 'g') AS raw_line FROM raw_order_lines", column="1", operation="initcap")
    for op in ("ne", "not_equal"):
        s(f"filter_{op}", "FilterRows", "sales_orders", "order_id customer_id", "SELECT order_id, customer_id FROM sales_orders WHERE customer_id <> 'C000001'", column="1", operator=op.upper(), value="C000001", trueStep="t")
    s("filter_eq", "FilterRows", "orders", "o_orderkey o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", column="1", operator="EQ", value="F", trueStep="t")
    s("filter_gt", "FilterRows", "orders", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000", column="1", operator="GT", value="200000", trueStep="t")
    s("filter_contains", "FilterRows", "part", "p_partkey p_type", "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'A')", column="1", operator="CONTAINS", value="A", trueStep="t")
    s("filter_false_branch", "FilterRows", "sales_orders", "order_id customer_id", "SELECT order_id, customer_id FROM sales_orders WHERE customer_id IS NULL OR customer_id = 'C000001'", column="1", operator="NEQ", value="C000001", falseStep="f")
    # aggregation
    s("memory_group_by", "MemoryGroupBy", "lineitem", "l_returnflag l_linestatus l_quantity l_extendedprice", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2", groupColumns="0,1", aggColumns="2,2,2,2,3", aggFunctions="COUNT,SUM,MIN,MAX,AVG", aggNames="n,q,lo,hi,mean")
    memory = _QUERIES["memory_group_by"]
    _QUERIES["memory_group_by"] = lambda spark, d: memory(spark, d).withColumn("mean", F.round("mean", 4))
    s("memory_group_by_first_last", "MemoryGroupBy", "events", "event_type event_id user_id", "SELECT event_type, arg_min(user_id, event_id) AS a, arg_max(user_id, event_id) AS b FROM events GROUP BY 1", order="event_id", groupColumns="0", aggColumns="2,2", aggFunctions="FIRST,LAST", aggNames="a,b")
    runs = "WITH x AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND event_id > 0 THEN 0 ELSE 1 END c FROM events), y AS (SELECT *, sum(c) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) r FROM x) "
    s("group_by_runs", "GroupBy", "events", "event_type event_id", runs + "SELECT event_type, count(*) AS n, CAST(min(event_id) AS DOUBLE) AS first_id, max(event_id) AS last_id FROM y GROUP BY event_type, r", order="event_id", groupColumns="0", aggColumns="1,1,1", aggFunctions="COUNT,MIN,LAST", aggNames="n,first_id,last_id")
    s("fields_change_sequence", "FieldsChangeSequence", "events", "event_id event_type", runs + "SELECT event_id, event_type, CAST(r AS BIGINT) AS k FROM y", order="event_id", columns="1", out="event_id event_type k")
    s("unique_consecutive", "Unique", "events", "event_id event_type", runs + "SELECT event_id, event_type FROM y WHERE c = 1", order="event_id", columns="1")
    s("unique_rows", "UniqueRowsByHashSet", "events", "event_id event_type user_id", "SELECT min(event_id) AS event_id, event_type, user_id FROM events GROUP BY event_type, user_id", order="event_id", columns="1,2")
    s("sequence", "Sequence", "events", "event_id", "SELECT event_id, 10 + 5 * (row_number() OVER (ORDER BY event_id) - 1) AS n FROM events", order="event_id", start="10", increment="5", out="event_id n")
    s("detect_last_row", "DetectLastRow", "events", "event_id", "SELECT event_id, CAST(event_id = max(event_id) OVER () AS VARCHAR) AS is_last FROM events", order="event_id", out="event_id is_last")
    s("denormaliser", "Denormaliser", "orders", "o_custkey o_orderstatus o_orderkey", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS F, arg_max(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1", order="o_orderkey", keyColumns="0", pivotColumn="1", valueColumn="2", pivotValues="F,O")
    s("normaliser", "Normaliser", "nation", "n_nationkey n_name n_regionkey", "SELECT n_nationkey, 'name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation", keyColumns="0", valueColumns="1,2", valueNames="name,region")
    s("blocking_step", "BlockingStep", "orders", "o_orderkey", "SELECT o_orderkey FROM orders")
    s("abort_not_hit", "Abort", "orders", "o_orderkey o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders", column="1", abortCondition="NULL")


_simple()


@_query("select_values", "SELECT n_regionkey, n_name, n_name AS again FROM nation")
def _select(spark, d):
    return _step(spark, "SelectValues", _frame(spark, d, "nation", "n_nationkey n_name n_regionkey"), columns="2,1,1").to_df(["n_regionkey", "n_name", "again"])


@_query("concat_fields", "SELECT order_id, coalesce(customer_id, '') || '-' || coalesce(product_id, '') AS k FROM sales_orders")
def _concat(spark, d):
    f = _step(spark, "ConcatFields", _frame(spark, d, "sales_orders", "order_id customer_id product_id"), columns="1,2", separator="-")
    return _step(spark, "SelectValues", f, columns="0,3", names="order_id,k").to_df()


@_query("switch_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'b' ELSE 'rest' END AS went FROM orders")
def _switch(spark, d):
    out = _step(spark, "SwitchCase", _frame(spark, d, "orders", "o_orderkey o_orderstatus"), column="1", case__F="a", case__O="b", defaultStep="rest")
    parts = [f.df.select(F.col("c0").alias("o_orderkey"), F.lit(k).alias("went")) for k, f in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _nulled(spark, d, name, columns, at, value):
    return _step(spark, "NullIf", _frame(spark, d, name, columns), column=str(at), value=value)


_CUSTOMER = "(SELECT c_custkey, nullif(c_nationkey, 7) AS k FROM customer)"
#: keys shifted by five, so that both sides have rows without a partner
_NATION = "(SELECT nullif(n_nationkey + 5, 7) AS j, n_name FROM nation)"


def _joins() -> None:
    for how in ("INNER", "LEFT OUTER", "RIGHT OUTER", "FULL OUTER"):
        sql = f"SELECT c_custkey, k, j, n_name FROM {_CUSTOMER} {how.split()[0]} JOIN {_NATION} ON k IS NOT DISTINCT FROM j"

        def join(spark, d, how=how):
            left = _nulled(spark, d, "customer", "c_custkey c_nationkey", 1, "7")
            right = Frame.of(table(spark, d, "nation").selectExpr("n_nationkey + 5 AS n_nationkey", "n_name"))
            right = _step(spark, "NullIf", right, column="0", value="7")
            return _step(spark, "MergeJoin", [left, right], leftColumns="1", rightColumns="0", joinType=how).to_df(["c_custkey", "k", "j", "n_name"])

        _query("merge_join_" + how.split()[0].lower(), sql)(join)


_joins()


@_query("stream_lookup", "WITH l AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS part FROM lineitem GROUP BY 1) SELECT o_orderkey, o_custkey, part FROM orders LEFT JOIN l ON o_orderkey = l_orderkey")
def _lookup(spark, d):
    main = _frame(spark, d, "orders", "o_orderkey o_custkey")
    look = _frame(spark, d, "lineitem", "l_orderkey l_partkey l_linenumber l_suppkey", "l_linenumber l_partkey l_suppkey")
    return _step(spark, "StreamLookup", [main, look], keyStreamCols="0", keyLookupCols="0", valueFieldCols="1", valueRenames="part").to_df()


@_query("multiway_merge_join", "SELECT n.n_nationkey AS a, n_name, c_nationkey AS b, c_custkey, s_nationkey AS c, s_suppkey FROM nation n JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON n_nationkey = s_nationkey")
def _multiway(spark, d):
    ins = [_frame(spark, d, "nation", "n_nationkey n_name"), _frame(spark, d, "customer", "c_nationkey c_custkey"), _frame(spark, d, "supplier", "s_nationkey s_suppkey")]
    return _step(spark, "MultiwayMergeJoin", ins, keyColumn="0").to_df(["a", "n_name", "b", "c_custkey", "c", "s_suppkey"])


@_query("join_rows", "SELECT r_name, n_name FROM region, nation")
def _product(spark, d):
    return _step(spark, "JoinRows", [_frame(spark, d, "region", "r_name"), _frame(spark, d, "nation", "n_name")]).to_df()


@_query("merge_rows", "WITH a AS (SELECT c_custkey, c_mktsegment FROM customer), b AS (SELECT c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1000000 ELSE 0 END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer) SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN a.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment, CASE WHEN a.c_custkey IS NULL THEN 'new' WHEN b.c_custkey IS NULL THEN 'deleted' WHEN a.c_mktsegment = b.c_mktsegment THEN 'identical' ELSE 'changed' END AS flag FROM a FULL JOIN b ON a.c_custkey = b.c_custkey")
def _diff(spark, d):
    # two versions of the table: some customers gone, some new, some changed
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = Frame.of(c, ["c_custkey"])
    moved = F.col("c_custkey") + F.when(F.col("c_custkey") % 4 == 0, 1_000_000).otherwise(0)
    new = Frame.of(c.select(moved.alias("key"), "*").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment"))).select(F.col("key").alias("c_custkey"), "c_mktsegment"), ["c_custkey"])
    return _step(spark, "MergeRows", [old, new], keyColumns="0").to_df()


@_query("group_by_sorted", "SELECT l_returnflag || '/' || l_linenumber AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
def _sorted_groups(spark, d):
    """The usual pair of steps: a sort, then groups of neighbours."""
    f = _step(spark, "ConcatFields", _frame(spark, d, "lineitem", "l_returnflag l_linenumber l_quantity"), columns="0,1", separator="/")
    f = _step(spark, "SortRows", f, columns="3")
    return _step(spark, "GroupBy", f, groupColumns="3", aggColumns="2,2", aggFunctions="COUNT,SUM", aggNames="n,q").to_df(["k", "n", "q"])


def _ranked(f: Frame, names: list[str]) -> DataFrame:
    g = f.positioned()
    return g.df.select(*[c.alias(n) for c, n in zip(g.fields(), names, strict=True)], (F.col("__pos") + 1).alias("rn"))


@_query("sort_rows", "SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_shipdate DESC NULLS FIRST, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem")
def _sort(spark, d):
    f = _step(spark, "SortRows", _frame(spark, d, "lineitem", "l_shipdate l_orderkey l_linenumber l_partkey"), columns="0,1,2,3", ascending="false,true,true,true")
    return _ranked(f, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])


@_query("sorted_merge", "SELECT k, name, row_number() OVER (ORDER BY name, k) AS rn FROM (SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region)")
def _merge(spark, d):
    f = _step(spark, "SortedMerge", [_frame(spark, d, "nation", "n_nationkey n_name"), _frame(spark, d, "region", "r_regionkey r_name")], columns="1,0")
    return _ranked(f, ["k", "name"])


@_query("append", "SELECT *, row_number() OVER (ORDER BY part, k) AS rn FROM (SELECT 0 AS part, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)")
def _append(spark, d):
    ins = [Frame.of(table(spark, d, t).select(F.lit(i).alias("part"), *cs), [cs[0]]) for i, (t, *cs) in enumerate((("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")))]
    return _ranked(_step(spark, "Append", ins), ["part", "k", "name"])


@_query("row_generator", "SELECT 'a' AS x, 'b' AS y FROM range(50)")
def _generated(spark, d):
    return _step(spark, "RowGenerator", [], rowLimit="50", field__0="a", field__1="b", fieldNames="x,y").to_df()


@_query("set_variable", "SELECT o_orderkey, o_orderpriority, arg_max(o_orderpriority, o_orderkey) OVER () AS last FROM orders")
def _variable(spark, d):
    """The variable is read back by the next step."""
    c = Context(spark)
    f = STEPS["SetVariable"]([_frame(spark, d, "orders", "o_orderkey o_orderpriority", "o_orderkey")], Params(column="1", variableName="LAST"), c)
    return STEPS["GetVariable"]([f], Params(variableName="LAST"), c).to_df(["o_orderkey", "o_orderpriority", "last"])


@_query("script_value_mod", "SELECT n_nationkey, n_name, upper(n_name) || '/' || CAST(length(n_name) AS VARCHAR) AS label FROM (SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation)")
def _script(spark, d):
    return _step(spark, "ScriptValueMod", _frame(spark, d, "nation", "n_nationkey n_name"), script="var label = n_name.toUpperCase() + '/' + n_name.length;", outputFields="label").to_df()


@_query("user_defined_java_class", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, reverse(n_name) AS n_name FROM nation")
def _java(spark, d):
    return _step(spark, "UserDefinedJavaClass", _frame(spark, d, "nation", "n_nationkey n_name"), script="fields[1] = new StringBuilder(fields[1]).reverse().toString(); return fields;").to_df()


@_query("system_info", "SELECT true AS day, true AS clock, true AS names, 1 AS n")
def _system(spark, d):
    """What can be said of it in advance: its form."""
    full = " AND ".join(f"length({c}) > 0" for c in ("hostname", "java_version", "os_name", "os_version"))
    return _step(spark, "SystemInfo", []).to_df().selectExpr(r"bool_and(date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS day".replace("date", "`date`", 1), r"bool_and(time rlike '^[0-9]{2}:[0-9]{2}:[0-9]{2}$') AS clock".replace("time", "`time`", 1), f"bool_and({full}) AS names", "CAST(count(1) AS int) AS n")


@_query("get_file_names", "SELECT parse_filename(file) AS name, true AS has_size FROM glob('/root/testdata/sf0.01/*.parquet')")
def _listing(spark, d):
    """The tables of a folder; all sizes of test data have the same."""
    return _step(spark, "GetFileNames", [], directory=d, glob="*.parquet").to_df().selectExpr("name", "CAST(size AS long) > 0 AS has_size")


@_query("file_exists", "SELECT c_name, 'false' AS there FROM customer")
def _exists(spark, d):
    return _step(spark, "FileExists", _frame(spark, d, "customer", "c_name"), column="0").to_df(["c_name", "there"])


_STAR = """
name: star
steps:
  - {id: filter, type: FilterRows, params: {column: "2", operator: EQ, value: F, trueStep: lookup}}
  - {id: lookup, type: StreamLookup, params: {lookupInputIndex: "1", keyStreamCols: "1", keyLookupCols: "0", valueFieldCols: "1"}}
  - {id: group, type: MemoryGroupBy, params: {groupColumns: "4", aggColumns: "3,3", aggFunctions: "COUNT,SUM", aggNames: "orders,total"}}
  - {id: out, type: MappingOutput}
hops:
  - {from: in, to: filter}
  - {from: filter, to: lookup}
  - {from: customers, to: lookup}
  - {from: lookup, to: group}
  - {from: group, to: out}
"""


def _star(spark: SparkSession, d: str) -> DataFrame:
    """The definition above, with frames in the place of its two sources."""
    definition = load_transformation(_STAR)
    from millrace.plans.model import StepDefinition
    from millrace.registry import SOURCES

    frames = {"in": _frame(spark, d, "orders", "o_orderkey o_custkey o_orderstatus o_totalprice"), "customers": _frame(spark, d, "customer", "c_custkey c_mktsegment")}
    for k, f in frames.items():
        kind = f"__frame_{k}"
        STEPS[kind] = lambda ins, p, c, f=f: f
        SOURCES.add(kind)
        definition.steps.insert(0, StepDefinition(k, kind))
    c = Context(spark)
    build(definition, c)
    return c.results["mapping"].to_df(["segment", "orders", "total"]).withColumn("total", F.round("total", 2))


_query("yaml_pipeline", "SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")(_star)


@_query("simple_mapping", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def _simple_subflow(spark, d):
    return _subflow(spark, d, "SimpleMapping")


@_query("mapping_subflow", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def _subflow(spark, d, kind="Mapping"):
    """A sub-flow's definition is a small file on the driver."""
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-flow-"), "sub.yaml")
    with open(path, "w", encoding="utf-8") as f:
        f.write('name: sub\nsteps:\n- {id: i, type: MappingInput}\n- {id: u, type: StringOperations, params: {column: "1", operation: upper}}\n- {id: o, type: MappingOutput}\nhops:\n- {from: i, to: u}\n- {from: u, to: o}\n')
    return _step(spark, kind, _frame(spark, d, "customer", "c_custkey c_name"), transformationPath=path).to_df()


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
