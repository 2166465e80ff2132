"""Database steps. Rows move in parallel by Spark's JDBC source; changes of existing rows are set statements against a
staging table, so that their cost doesn't grow with round trips. A database inside the driver's JVM is read and written
by the driver, as executors can't see it."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core.runtime import materialise_batches
from millrace.frame import POS, Frame, Order
from millrace.registry import Context, Params, step

log = logging.getLogger("millrace.jdbc")

#: drivers and ports of databases (fixed values)
DRIVERS = {
    "oracle": ("oracle.jdbc.OracleDriver", 1521),
    "mysql": ("com.mysql.cj.jdbc.Driver", 3306),
    "postgres": ("org.postgresql.Driver", 5432),
    "postgresql": ("org.postgresql.Driver", 5432),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "mssql": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "h2": ("org.h2.Driver", 9092),
    "db2": ("com.ibm.db2.jcc.DB2Driver", 50000),
    "derby": ("org.apache.derby.iapi.jdbc.AutoloadedDriver", 1527),
}
#: rows that the driver holds at once of a database in its own JVM
ROWS_AT_ONCE = 50_000


def driver_of(p: Params) -> str:
    if p.text("jdbcDriver"):
        return p["jdbcDriver"]
    kind = p.text("dbType", "").strip().lower()
    if kind not in DRIVERS:
        raise ValueError(f"unknown database type {kind!r}; give jdbcDriver or dbType")
    return DRIVERS[kind][0]


def url_of(p: Params) -> str:
    if p.text("jdbcUrl"):
        return p["jdbcUrl"]
    kind = p.text("dbType", "").strip().lower()
    if kind not in DRIVERS:
        raise ValueError("give jdbcUrl, or dbType and jdbcHost")
    host, base = p.text("jdbcHost", "localhost"), p.text("jdbcDatabase", "")
    at = f"{host}:{p.text('jdbcPort') or DRIVERS[kind][1]}"
    match kind:
        case "oracle":
            return f"jdbc:oracle:thin:@//{at}/{p['jdbcServiceName']}" if p.text("jdbcServiceName") else f"jdbc:oracle:thin:@{at}:{p.text('jdbcSid') or base}"
        case "postgres" | "postgresql":
            return f"jdbc:postgresql://{at}/{base}"
        case "sqlserver" | "mssql":
            return f"jdbc:sqlserver://{at};databaseName={base}"
        case "h2":
            return f"jdbc:h2:tcp://{at}/{base}" if p.text("jdbcHost") else f"jdbc:h2:mem:{base}"
        case "derby":
            return f"jdbc:derby://{at}/{base}" if p.text("jdbcHost") else f"jdbc:derby:memory:{base};create=true"
    return f"jdbc:{kind}://{at}/{base}"


def _options(p: Params) -> dict[str, str]:
    out = {"url": url_of(p), "driver": driver_of(p)}
    if p.text("jdbcUser"):
        out |= {"user": p["jdbcUser"], "password": p.text("jdbcPassword", "")}
    return out


def _embedded(p: Params) -> bool:
    """The database is in the driver's JVM; executors would see another, empty one."""
    url = url_of(p)
    return url.startswith("jdbc:h2:mem:") or url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")


def drop_embedded(p: Params, c: Context) -> None:
    """Remove a Derby database from the driver's memory, as far as it is in there."""
    if (url := url_of(p)).startswith("jdbc:derby:memory:"):
        try:
            c.spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url.split(";")[0] + ";drop=true")
        except Py4JJavaError as e:  # Derby reports what it dropped as an error, and what it has not
            if e.java_exception.getSQLState() not in ("08006", "XJ004"):
                raise


class _Connection:
    """A connection of the driver's JVM; one transaction."""

    def __init__(self, p: Params, c: Context):
        jvm = c.spark.sparkContext._jvm
        o = _options(p)
        props = jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in o:
                props.setProperty(k, o[k])
        jvm.org.apache.spark.util.Utils.classForName(o["driver"], True, False)
        self.own = jvm.java.sql.DriverManager.getConnection(o["url"], props)
        self.own.setAutoCommit(False)

    def __enter__(self):
        return self

    def run(self, sql: str) -> int:
        s = self.own.createStatement()
        try:
            return s.executeUpdate(sql)
        finally:
            s.close()

    def columns(self, table: str) -> list[str]:
        s = self.own.createStatement()
        try:
            meta = s.executeQuery(f"SELECT * FROM {table} WHERE 1 = 0").getMetaData()
            return [meta.getColumnName(i + 1) for i in range(meta.getColumnCount())]
        finally:
            s.close()

    def __exit__(self, kind, *_):
        self.own.rollback() if kind else self.own.commit()
        self.own.close()


@step("TableInput", source=True)
def table_input(ins: list[Frame], p: Params, c: Context) -> Frame:
    """`query`, else the table with its whereClause. With partitionColumn, lowerBound, upperBound and numPartitions the
    table is read in parallel. A database in the driver's JVM is read by the driver, when the step is reached."""
    sql = p.text("query") or f"SELECT * FROM {p.required('tableName')}" + (f" WHERE {p['whereClause']}" if p.text("whereClause") else "")
    reader = c.spark.read.format("jdbc").options(**_options(p)).option("fetchsize", p.integer("fetchSize", 1000))
    if p.text("partitionColumn"):
        reader = reader.options(dbtable=f"({sql}) q", **{k: p.required(k) for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")})
    else:
        reader = reader.option("query", sql.rstrip().rstrip(";"))
    return _fetched(reader.load(), sql, p, c) if _embedded(p) else Frame.of(reader.load(), text=True)


def _fetched(like: DataFrame, sql: str, p: Params, c: Context) -> Frame:
    """The rows of a query, with the types of `like`, written to the shared folder in batches and numbered as they came."""
    jvm = c.spark.sparkContext._jvm

    def batches(rows) -> Iterator[DataFrame]:
        start = 0
        while start == 0 or rows.hasNext():
            some = jvm.scala.collection.JavaConverters.seqAsJavaList(rows.next()) if rows.hasNext() else jvm.java.util.ArrayList()
            df = DataFrame(c.spark._jsparkSession.createDataFrame(some, like._jdf.schema()), c.spark).toDF(*[f"c{i}" for i in range(len(like.columns))])
            yield df.coalesce(1).select(*[F.col(x).cast("string").alias(x) for x in df.columns], (F.lit(start).cast("long") + F.monotonically_increasing_id()).alias("__o0"))
            start += max(some.size(), 1)

    with _Connection(p, c) as db:
        s = db.own.createStatement()
        try:
            s.setFetchSize(p.integer("fetchSize", 1000))
            rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(s.executeQuery(sql.rstrip().rstrip(";")), like._jdf.schema())
            df = materialise_batches(c.spark, batches(rows.grouped(ROWS_AT_ONCE)))
        finally:
            s.close()
    return Frame(df, tuple(like.columns), (Order("__o0"),), text=True)


@step("TableOutput", effect=True, narrow=True)
def table_output(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Fields go to the table's columns by position; truncateFirst deletes its rows before."""
    f, table = ins[0], p.required("tableName")
    with _Connection(p, c) as db:
        columns = db.columns(table)
        if p.flag("truncateFirst", False):
            db.run(f"DELETE FROM {table}")
    _write(f.df.select(*[f.col(i).alias(n) for i, n in enumerate(columns)]), table, p, c)
    return f


def _write(df, table: str, p: Params, c: Context) -> None:
    """Append rows in parallel. Derby's databases are written by the driver: one in its own JVM imports a file of the rows, in
    one transaction; for others Spark's dialect sends null texts as CLOB, which VARCHAR columns refuse."""
    if "derby" not in url_of(p) and not _embedded(p):
        df.write.format("jdbc").options(**_options(p)).option("dbtable", table).option("batchsize", p.integer("batchSize", 1000)).mode("append").save()
        return
    texts = df.select(*[F.col(x).cast("string") for x in df.columns])
    with _Connection(p, c) as db:
        if "derby" in url_of(p) and _embedded(p):
            _import(db, texts, table)
        else:
            s = db.own.prepareStatement(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ({', '.join('?' * len(df.columns))})")
            _batched(s, texts, p.integer("batchSize", 1000))


def _import(db: _Connection, texts: DataFrame, table: str) -> None:
    """Derby reads a file by itself: no value crosses from Python on its own. What isn't null is quoted."""
    quoted = [F.when(F.col(x).isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(F.col(x), F.lit('"'), F.lit('""')), F.lit('"'))) for x in texts.columns]
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", newline="", suffix=".csv") as f:
        n = 0
        for (line,) in texts.select(F.concat_ws(",", *quoted)).toLocalIterator():
            f.write(line + "\n")
            n += 1
        f.flush()
        s = db.own.createStatement()
        meta = s.executeQuery(f"SELECT {', '.join(texts.columns)} FROM {table} WHERE 1 = 0").getMetaData()
        names = ",".join(meta.getColumnName(i + 1) for i in range(len(texts.columns)))
        where = meta.getSchemaName(1), meta.getTableName(1)
        s.close()
        if n:
            call = db.own.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, ?, NULL, ?, ',', '\"', 'UTF-8', 0)")
            for k, v in enumerate((*where, names, f.name)):
                call.setString(k + 1, v)
            call.execute()
            call.close()


def _batched(s, df, size: int) -> None:
    n = 0
    for row in df.toLocalIterator():
        for k, v in enumerate(row):
            s.setString(k + 1, v)
        s.addBatch()
        n += 1
        if n % size == 0:
            s.executeBatch()
    if n % size:
        s.executeBatch()
    s.close()


def _staged(f: Frame, p: Params, c: Context, columns: list[str], keys: list[str]):
    """The last row of each key, written to a staging table like the target; a key with a null equals no other, so that each of
    its rows counts."""
    g = f.positioned()
    at = {n: i for i, n in enumerate(columns)}
    alone = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.col(POS)).alias("alone")
    last = g.df.select(*[g.col(at[n]).alias(n) for n in columns], POS).groupBy(*keys, alone).agg(F.max_by(F.struct(*columns), POS).alias("v")).select("v.*")
    stage = "MR_" + uuid.uuid4().hex[:16].upper()
    with _Connection(p, c) as db:
        db.run(f"CREATE TABLE {stage} AS SELECT {', '.join(columns)} FROM {p['tableName']} WITH NO DATA" if "derby" in url_of(p) else f"CREATE TABLE {stage} AS SELECT {', '.join(columns)} FROM {p['tableName']} WHERE 1 = 0")
    _write(last, stage, p, c)
    try:
        with _Connection(p, c) as db:  # else each changed row scans the staging table
            db.run(f"CREATE INDEX {stage}_K ON {stage} ({', '.join(keys)})")
    except Py4JJavaError as e:  # the database has no index over such columns; the statements need none
        log.warning("no index on %s (%s): %s", stage, ", ".join(keys), e.java_exception.getMessage())
    return stage


def _same(keys: list[str], table: str, stage: str) -> str:
    return " AND ".join(f"{stage}.{k} = {table}.{k}" for k in keys)


@step("InsertUpdate", effect=True, narrow=True)
def insert_update(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Rows whose key exists are updated, the others inserted, as are all with a null in their key; of rows with one key the
    last counts. The rows pass on."""
    f, table, columns, keys = ins[0], p.required("tableName"), p.items_of("columns"), p.items_of("keyFields")
    rest = p.items_of("updateFields") or [x for x in columns if x not in keys]
    stage = _staged(f, p, c, columns, keys)
    on = _same(keys, table, stage)
    with _Connection(p, c) as db:
        if rest:
            sets = ", ".join(f"{x} = (SELECT {stage}.{x} FROM {stage} WHERE {on})" for x in rest)
            db.run(f"UPDATE {table} SET {sets} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {on})")
        db.run(f"INSERT INTO {table} ({', '.join(columns)}) SELECT {', '.join(columns)} FROM {stage} WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {on})")
        db.run(f"DROP TABLE {stage}")
    return f


@step("Delete", effect=True, narrow=True)
def delete(ins: list[Frame], p: Params, c: Context) -> Frame:
    f, table, keys = ins[0], p.required("tableName"), p.items_of("keyFields")
    stage = _staged(f, p, c, p.items_of("columns") or keys, keys)
    with _Connection(p, c) as db:
        db.run(f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {_same(keys, table, stage)})")
        db.run(f"DROP TABLE {stage}")
    return f


@step("ExecSQL", effect=True, narrow=True)
def exec_sql(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The statement for each row in order, with the fields of paramFields as parameters; rows come a partition at a
    time, as each is a round trip to the database anyway. No row: it never runs."""
    f = ins[0]
    fields = [f.index(x) for x in p.items_of("paramFields")]
    with _Connection(p, c) as db:
        rows = f.sorted().select(*[f.col(i).cast("string").alias(f"p{k}") for k, i in enumerate(fields)] or [F.lit(None).cast("string")])
        s = db.own.prepareStatement(p.required("sql"))
        if fields:
            _batched(s, rows, 1000)
        else:
            for _ in rows.toLocalIterator():
                s.executeUpdate()
    return f
