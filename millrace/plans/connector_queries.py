"""Registered queries of the steps that read and write outside: each writes to the shared folder (or an embedded
database), reads back, and has the SQL of what must come back."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import ClassVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from millrace.core.runtime import shared_dir, table
from millrace.frame import Frame
from millrace.plans.compiler import run_transformation
from millrace.plans.jobs import JobContext, run_job
from millrace.registry import STEPS, Context, Params

_ORDERS = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders"
_CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer"


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see; these queries need a shared file system."""
    path = os.path.join(urlparse(shared_dir(spark)).path, "millrace", uuid.uuid4().hex)
    os.makedirs(path)
    return path


def _of(spark: SparkSession, d: str, name: str, *columns: str) -> Frame:
    """A whole table as texts, ordered by its first column."""
    return Frame.of(table(spark, d, name).select(*columns), [columns[0]], text=True)


def _orders(spark: SparkSession, d: str) -> Frame:
    return _of(spark, d, "orders", "o_orderkey", "o_orderpriority")


def _run(spark: SparkSession, kind: str, ins: list[Frame], context: Context | None = None, **params) -> Frame:
    return STEPS[kind](ins, Params({k.replace("__", "."): v for k, v in params.items()}), context or Context(spark))


def _csv(spark: SparkSession, d: str, strict: str) -> DataFrame:
    path = os.path.join(_folder(spark), "orders.csv")
    _run(spark, "TextFileOutput", [_orders(spark, d)], filePath=path, writeHeader="true", fieldNames="o_orderkey,o_orderpriority")
    return _run(spark, "CsvInput", [], filePath="file://" + path, strict=strict).to_df()


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _csv(spark, d, "false")


def csv_strict_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _csv(spark, d, "true")


def csv_strict_folder(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a header each, read line by line."""
    path = "file://" + os.path.join(_folder(spark), "parts")
    _run(spark, "TextFileOutput", [_orders(spark, d)], filePath=path, partitioned="true", writeHeader="true", fieldNames="o_orderkey,o_orderpriority")
    return _run(spark, "CsvInput", [], filePath=path, strict="true").to_df()


def text_file_input_no_header(spark: SparkSession, d: str) -> DataFrame:
    path = os.path.join(_folder(spark), "orders.txt")
    _run(spark, "TextFileOutput", [_orders(spark, d)], filePath=path, outputCols="1,0")
    return _run(spark, "TextFileInput", [], filePath="file://" + path, hasHeader="false", fieldNames="o_orderpriority,o_orderkey").to_df()


def partitioned_output(spark: SparkSession, d: str) -> DataFrame:
    path = "file://" + os.path.join(_folder(spark), "parts")
    _run(spark, "TextFileOutput", [_orders(spark, d)], filePath=path, partitioned="true")
    return spark.read.csv(path, schema="o_orderkey string, o_orderpriority string")


def excel_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written to a workbook, suppliers appended."""
    path = os.path.join(_folder(spark), "names.xlsx")
    _run(spark, "ExcelOutput", [_of(spark, d, "customer", "c_custkey", "c_name")], filePath=path)
    _run(spark, "TypeExitExcelWriter", [_of(spark, d, "supplier", "s_suppkey", "s_name")], filePath=path)
    return _run(spark, "ExcelInput", [], filePath=path).to_df(["k", "name"])


def property_input(spark: SparkSession, d: str) -> DataFrame:
    path = os.path.join(_folder(spark), "nation.properties")
    with open(path, "w", encoding="latin-1") as f:
        for r in table(spark, d, "region").select("r_regionkey", "r_name").toLocalIterator():
            f.write(f"key{r[0]} = {r[1]}\n")
    return _run(spark, "PropertyInput", [], filePath=path).to_df(["k", "v"])


def files_rows_count(spark: SparkSession, d: str) -> DataFrame:
    """Copies, moves, deletes and zips files, then asks for the lines and the presence of all."""
    folder = _folder(spark)
    a, b, m, x, z = (os.path.join(folder, n) for n in ("a.csv", "b.csv", "m.csv", "x.csv", "b.zip"))
    _run(spark, "TextFileOutput", [_orders(spark, d)], filePath=a)
    pairs = lambda *v: [Frame.of(spark.createDataFrame(list(v), "x string, y string"), ["x"], text=True)]
    _run(spark, "ProcessFiles", pairs((a, b)))
    _run(spark, "ProcessFiles", pairs((a, x)))
    _run(spark, "ZipFile", pairs((b, z)))
    _run(spark, "ProcessFiles", pairs((a, m)), operation="MOVE")
    _run(spark, "ProcessFiles", pairs((x, "")), operation="DELETE")
    rows = Frame.of(spark.createDataFrame([(1, "moved away", a), (2, "copy", b), (3, "zip", z), (4, "moved", m), (5, "deleted", x)], "at int, name string, path string"), ["at"])
    f = _run(spark, "FileExists", [_run(spark, "GetFilesRowsCount", [rows], column="2", hasHeader="false")], column="2")
    f = _run(spark, "FileLocked", [f], column="2")
    return f.to_df(["at", "name", "path", "n", "there", "locked"]).selectExpr("name", "CASE WHEN name = 'zip' THEN NULL ELSE n END AS n", "there", "locked")


@contextmanager
def _database(spark: SparkSession, d: str) -> Iterator[tuple[dict, Context]]:
    """A database of all customers in the driver's memory, keys missing or repeated too, which is given back at the end; what
    was read of it stays."""
    from millrace.sources.jdbc import _Connection, drop_embedded

    p, c = {"dbType": "derby", "jdbcDatabase": "q" + uuid.uuid4().hex}, Context(spark)
    with _Connection(Params(p), c) as db:
        db.run("CREATE TABLE CUSTOMERS (C_KEY VARCHAR(20), C_NAME CLOB)")
    try:
        _run(spark, "TableOutput", [_of(spark, d, "customer", "c_custkey", "c_name")], c, tableName="CUSTOMERS", **p)
        with _Connection(Params(p), c) as db:  # of the filled table, so that Derby knows how selective it is
            db.run("CREATE INDEX CUSTOMERS_K ON CUSTOMERS (C_KEY)")
        yield p, c
    finally:
        drop_embedded(Params(p), c)


def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    with _database(spark, d) as (p, c):
        return _run(spark, "TableInput", [], c, query="SELECT C_KEY, C_NAME FROM CUSTOMERS", **p).to_df(["c_custkey", "c_name"])


def insert_update(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers, under the key of the customer with their number, and one row more. Those without a name leave the
    customer's name as it is, and are only added where there is no such customer."""
    with _database(spark, d) as (p, c):
        part = _run(spark, "FilterRows", [_of(spark, d, "supplier", "s_suppkey", "s_name")], column="1", operator="NE", trueStep="named", falseStep="unnamed")
        new = _run(spark, "Formula", [part["named"]], formulaString='CONCATENATE("new ";[s_name])', fieldName="x")
        new = _run(spark, "SelectValues", [new], columns="0,2")
        more = Frame.of(spark.createDataFrame([("x1", "added")], "a string, b string"), ["a"], text=True)
        _run(spark, "InsertUpdate", [_run(spark, "Append", [new, more])], c, tableName="CUSTOMERS", columns="C_KEY,C_NAME", keyFields="C_KEY", **p)
        _run(spark, "InsertUpdate", [part["unnamed"]], c, tableName="CUSTOMERS", columns="C_KEY", keyFields="C_KEY", **p)
        return _run(spark, "TableInput", [], c, tableName="CUSTOMERS", **p).to_df(["c_custkey", "c_name"])


def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the key of a supplier are marked, those with the key of a nation deleted."""
    with _database(spark, d) as (p, c):
        _run(spark, "ExecSQL", [_of(spark, d, "supplier", "s_suppkey", "s_name")], c, sql="UPDATE CUSTOMERS SET C_NAME = 'seen' WHERE C_KEY = ?", paramFields="0", **p)
        _run(spark, "Delete", [_of(spark, d, "nation", "n_nationkey", "n_name")], c, tableName="CUSTOMERS", columns="C_KEY,C_NAME", keyFields="C_KEY", **p)
        return _run(spark, "TableInput", [], c, tableName="CUSTOMERS", **p).to_df(["c_custkey", "c_name"])


def rows_to_result(spark: SparkSession, d: str) -> DataFrame:
    c = Context(spark, log=lambda _: None)
    f = _run(spark, "WriteToLog", [_orders(spark, d)], c)
    _run(spark, "RowsToResult", [_run(spark, "DetectEmptyStream", [f], c)], c)
    return _run(spark, "RowsFromResult", [], c).to_df()


def detect_empty_stream(spark: SparkSession, d: str) -> DataFrame:
    """The flag of a table, and of what a filter that nothing passes leaves of it."""
    flags = []
    for value in ("", "no such priority"):
        c, f = Context(spark), _orders(spark, d)
        if value:
            f = _run(spark, "FilterRows", [f], column="1", value=value, trueStep="t")["t"]
        _run(spark, "DetectEmptyStream", [f], c)
        flags.append((value or "all", str(c.results["empty"]).lower()))
    return spark.createDataFrame(flags, "rows_of string, empty string")


def mapping_chain(spark: SparkSession, d: str) -> DataFrame:
    c = Context(spark, mapping_input=_orders(spark, d))
    return _run(spark, "MappingOutput", [_run(spark, "MappingInput", [], c)], c).to_df()


def exec_process(spark: SparkSession, d: str) -> DataFrame:
    """The command is a constant of this query, not data. Each row starts a process, so the table is a small one."""
    f = _run(spark, "Constant", [_of(spark, d, "nation", "n_nationkey", "n_name")], value__0="echo out; exit 3")
    return _run(spark, "ExecProcess", [f], Context(spark, allow_exec=True), commandColumn="2").to_df(["n_nationkey", "n_name", "command", "line", "code"]).drop("command")


def rest_unreachable(spark: SparkSession, d: str) -> DataFrame:
    f = _run(spark, "Rest", [_of(spark, d, "nation", "n_nationkey", "n_name")], url="http://127.0.0.1:9/", timeoutMs="500")
    return f.to_df(["n_nationkey", "n_name", "body", "code"]).drop("body")


class _Echo(BaseHTTPRequestHandler):
    def do_POST(self) -> None:
        body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
        self.send_response(201 if self.path == "/made" else 404)
        self.end_headers()
        self.wfile.write(b"got " + body)

    def log_message(self, *_) -> None:
        pass


def rest_answers(spark: SparkSession, d: str) -> DataFrame:
    """Requests to a server of the driver's own, which lives as long as the driver; answers and errors come back."""
    server = ThreadingHTTPServer(("", 0), _Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
    made = _run(spark, "Rest", [_of(spark, d, "nation", "n_nationkey", "n_name")], url=f"http://{host}:{server.server_port}/made", method="POST", bodyColumn="1", timeoutMs="20000")
    return _run(spark, "Rest", [made], url=f"http://{host}:{server.server_port}/none", method="POST", bodyColumn="0", timeoutMs="20000").to_df(["n_nationkey", "n_name", "body", "code", "body2", "code2"])


def job_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """A job of two transformations: the second reads what the first wrote, and runs only if its file is there."""
    folder = _folder(spark)
    _run(spark, "TextFileOutput", [_orders(spark, d)], filePath=f"{folder}/in.csv", writeHeader="true", fieldNames="o_orderkey,o_orderpriority")
    one = f'name: one\nsteps:\n- {{id: r, type: CsvInput, params: {{filePath: "file://{folder}/in.csv"}}}}\n- {{id: f, type: FilterRows, params: {{column: "0", operator: GTE, value: "1000", trueStep: w}}}}\n- {{id: w, type: TextFileOutput, params: {{filePath: "{folder}/mid.csv"}}}}\nhops:\n- {{from: r, to: f}}\n- {{from: f, to: w}}\n'
    two = f'name: two\nsteps:\n- {{id: r, type: CsvInput, params: {{filePath: "file://{folder}/mid.csv", hasHeader: "false"}}}}\n- {{id: s, type: SortRows, params: {{columns: "1,0", ascending: "false,true"}}}}\n- {{id: n, type: Sequence}}\n- {{id: w, type: TextFileOutput, params: {{filePath: "{folder}/out.csv"}}}}\nhops:\n- {{from: r, to: s}}\n- {{from: s, to: n}}\n- {{from: n, to: w}}\n'
    for name, text in (("one.yaml", one), ("two.yaml", two)):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    entries = [("start", "Start", {}), ("one", "RunTransformation", {"transformationPath": "x/one.yaml"}), ("there", "FileExists", {"filePath": f"{folder}/mid.csv"}), ("two", "RunTransformation", {"transformationPath": "two.yaml"}), ("bad", "Abort", {"message": "no file"})]
    hops = [("start", "one", None), ("one", "there", "success"), ("there", "two", "success"), ("there", "bad", "failure")]
    done = run_job(spark, _job(entries, hops), {"basePath": folder})
    if not done:
        raise RuntimeError("the job failed")
    return spark.read.csv(f"file://{folder}/out.csv", schema="o_orderkey string, o_orderpriority string, n string")


def _job(entries: list[tuple], hops: list[tuple]) -> dict:
    return {"name": "j", "entries": [{"id": i, "type": t, "params": p} for i, t, p in entries], "hops": [{"from": a, "to": b, "evaluation": e} for a, b, e in hops]}


class _Outbox:
    """Takes mails in the place of a server."""

    sent: ClassVar[list] = []

    def __init__(self, host: str, port: int, timeout: int):
        self.host = host

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        pass

    def send_message(self, m) -> None:
        self.sent.append((self.host, m["Subject"], m.get_content().strip()))


def job_entries(spark: SparkSession, d: str) -> DataFrame:
    """A job of all other entries: what they leave behind, and the results of jobs that end in an abort or a failed one."""
    with _database(spark, d) as (p, _):
        entries = [("s", "Start", {}), ("set", "SetVariable", {"variableName": "X", "variableValue": "7"}), ("get", "GetVariable", {"variableName": "NO_SUCH_VARIABLE_HERE", "contextKey": "Y"}), ("log", "WriteToLog", {"message": "hello"}), ("d", "Dummy", {}), ("p", "ExecProcess", {"command": "true"}), ("sql", "ExecSQL", {"sql": "UPDATE CUSTOMERS SET C_NAME = 'seen'", **p}), ("m", "Mail", {"host": "h", "from": "a@example.org", "to": "b@example.org", "subject": "done", "body": "all"}), ("e", "Success", {})]
        hops = [(a[0], b[0], "success") for a, b in zip(entries, entries[1:], strict=False)]
        _Outbox.sent.clear()
        c = JobContext(spark, {}, allow_exec=True, mail=_Outbox)
        rows = [("result", run_job(spark, _job(entries, hops), c)), ("X", c.values["X"]), ("Y", c.values["Y"]), ("mail", "/".join(_Outbox.sent[0]))]
        rows.append(("seen", _run(spark, "TableInput", [], tableName="CUSTOMERS", **p).to_df(["k", "name"]).where("name = 'seen'").count()))
    rows.append(("aborted", run_job(spark, _job([("s", "Start", {}), ("a", "Abort", {"message": "stop"})], [("s", "a", None)]))))
    rows.append(("failed command", run_job(spark, _job([("s", "Start", {}), ("a", "ExecProcess", {"command": "exit 4"})], [("s", "a", None)]), JobContext(spark, {}, allow_exec=True))))
    rows.append(("no file", run_job(spark, _job([("s", "FileExists", {"filePath": "/no/such/file"}), ("a", "Success", {}), ("b", "Dummy", {})], [("s", "a", "failure"), ("s", "b", "success")]))))
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, got string")


def abort_hit(spark: SparkSession, d: str) -> DataFrame:
    """The message with which a pipeline over all orders stops, and that it doesn't where no row meets the condition."""
    out = []
    for condition in ("EMPTY", "NOT_NULL", "NULL", "NOT_EMPTY"):
        f = _run(spark, "Abort", [_orders(spark, d)], column="1", abortCondition=condition, message="stopped here")
        try:
            out.append((condition, str(f.to_df().count())))
        except Exception as e:
            out.append((condition, "stopped here" if "stopped here" in str(e) else "another error"))
    return spark.createDataFrame(out, "condition string, got string")


def xml_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """An XML transformation, converted and run."""
    from millrace.plans.convert import convert_transformation

    folder = _folder(spark)
    _run(spark, "TextFileOutput", [_of(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")], filePath=f"{folder}/in.csv", writeHeader="true", fieldNames="k,name,region")
    xml = f"""<transformation><info><name>x</name></info>
<step><name>in</name><type>CSVInput</type><filename>file://{folder}/in.csv</filename><fields><field><name>k</name></field><field><name>name</name></field><field><name>region</name></field></fields></step>
<step><name>sort</name><type>SortRows</type><fields><field><name>region</name></field></fields></step>
<step><name>group</name><type>GroupBy</type><group><field><name>region</name></field></group><fields><field><aggregate>n</aggregate><subject>k</subject><type>COUNT</type></field></fields></step>
<step><name>out</name><type>TextFileOutput</type><file><name>{folder}/out.csv</name><header>N</header></file><fields><field><name>n</name></field><field><name>region</name></field></fields></step>
<order><hop><from>in</from><to>sort</to></hop><hop><from>sort</from><to>group</to></hop><hop><from>group</from><to>out</to></hop></order></transformation>"""
    run_transformation(spark, convert_transformation(xml))
    return spark.read.csv(f"file://{folder}/out.csv", schema="n string, priority string")


def stream_steps(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming import stream_steps as apply

    folder = "file://" + _folder(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("o_orderkey long, o_orderpriority string").parquet(f"{folder}/in")
    out = apply(stream, [("FilterRows", {"column": "0", "operator": "GT", "value": "4"}), ("StringOperations", {"column": "1", "operation": "lower"})])
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def queries() -> dict:
    named = [csv_round_trip, csv_strict_round_trip, csv_strict_folder, text_file_input_no_header, partitioned_output, excel_round_trip, property_input, files_rows_count, table_round_trip, insert_update, delete_rows, rows_to_result, detect_empty_stream, mapping_chain, exec_process, rest_unreachable, rest_answers, job_pipeline, job_entries, abort_hit, xml_pipeline, stream_steps]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    same = dict.fromkeys(("csv_round_trip", "csv_strict_round_trip", "csv_strict_folder", "text_file_input_no_header", "partitioned_output", "rows_to_result", "mapping_chain"), _ORDERS)
    return same | {
        "excel_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name FROM supplier",
        "property_input": "SELECT 'key' || r_regionkey AS k, r_name AS v FROM region",
        "files_rows_count": "SELECT name, CASE WHEN name IN ('copy', 'moved') THEN CAST((SELECT count(*) FROM orders) AS VARCHAR) END AS n, CASE WHEN name IN ('moved away', 'deleted') THEN 'false' ELSE 'true' END AS there, CASE WHEN name IN ('moved away', 'deleted') THEN 'true' ELSE 'false' END AS locked FROM (VALUES ('moved away'), ('copy'), ('zip'), ('moved'), ('deleted')) v(name)",
        "table_round_trip": _CUSTOMER,
        "insert_update": "SELECT CAST(coalesce(c_custkey, s_suppkey) AS VARCHAR) AS c_custkey, coalesce('new ' || s_name, c_name) AS c_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT 'x1', 'added'",
        "delete_rows": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'seen' ELSE c_name END AS c_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)",
        "detect_empty_stream": "SELECT * FROM (VALUES ('all', 'false'), ('no such priority', 'true')) v(rows_of, empty)",
        "exec_process": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, 'out' AS line, '3' AS code FROM nation",
        "rest_unreachable": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, '-1' AS code FROM nation",
        "rest_answers": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, 'got ' || n_name AS body, '201' AS code, 'got ' || n_nationkey AS body2, '404' AS code2 FROM nation",
        "job_pipeline": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority DESC, CAST(o_orderkey AS VARCHAR)) AS VARCHAR) AS n FROM orders WHERE o_orderkey >= 1000",
        "job_entries": "SELECT what, CASE WHEN what = 'seen' THEN CAST((SELECT count(*) FROM customer) AS VARCHAR) ELSE got END AS got FROM (VALUES ('result', 'True'), ('X', '7'), ('Y', ''), ('mail', 'h/done/all'), ('seen', ''), ('aborted', 'False'), ('failed command', 'False'), ('no file', 'True')) v(what, got)",
        "abort_hit": "SELECT condition, CASE WHEN got = '' THEN CAST((SELECT count(*) FROM orders) AS VARCHAR) ELSE got END AS got FROM (VALUES ('EMPTY', ''), ('NOT_NULL', 'stopped here'), ('NULL', ''), ('NOT_EMPTY', 'stopped here')) v(condition, got)",
        "xml_pipeline": "SELECT CAST(count(*) AS VARCHAR) AS n, o_orderpriority AS priority FROM orders GROUP BY 2",
        "stream_steps": "SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderkey > 4",
    }
