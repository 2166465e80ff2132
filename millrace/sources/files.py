"""File sources and sinks: delimited text, properties, listings, generated rows, results handed over."""

from __future__ import annotations

import glob as globbing
import os
import platform
import re
import shutil
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow, write_shared
from millrace.frame import Frame
from millrace.registry import Context, Params, step


def toggled_fields(line: str) -> list[str | None]:
    """Fields of one line: a quote switches quoting wherever it stands, a doubled one inside is a quote; empty is null."""
    out, part, quoted, i = [], [], False, 0
    while i < len(line):
        x = line[i]
        if x == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                part.append('"')
                i += 1
            else:
                quoted = not quoted
        elif x == "," and not quoted:
            out.append("".join(part) or None)
            part = []
        else:
            part.append(x)
        i += 1
    return [*out, "".join(part) or None]


def local_path(path: str, p: Params, c: Context) -> str:
    """The file itself, or with sftpHost what the context's fetch function downloads."""
    if not p.text("sftpHost"):
        return path
    if not (p.text("sftpPassword") or p.text("sftpPrivateKeyPath")):
        raise ValueError("SFTP needs sftpPassword or sftpPrivateKeyPath")
    if c.fetch is None:
        raise RuntimeError("no SFTP client: give the context a fetch(params) -> bytes function")
    data = c.fetch(dict(p) | {"filePath": path, "sftpPort": p.text("sftpPort", "22")})
    # into the shared folder, so that executors can read it
    return write_shared(c.spark, os.path.basename(path), data)


@step("CsvInput", "TextFileInput", source=True)
def delimited_input(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Comma and double quote, whatever separator and enclosure say; empty fields are null; no field spans lines.

    By default Spark's reader is used: it leaves blank lines and surplus fields out. With strict=true every line gives
    a row and quotes switch wherever they stand.
    """
    path, header = local_path(p.required("filePath"), p, c), p.flag("hasHeader", True)
    lines = c.spark.read.text(path)
    first = lines.first()
    head = toggled_fields(first[0]) if first else []
    names = p.items_of("fieldNames") or ([h or f"f{i}" for i, h in enumerate(head)] if header else [])
    names += [f"f{i}" for i in range(len(names), len(head))]
    if not p.flag("strict", False):
        schema = ", ".join(f"c{i} string" for i in range(len(names))) or "c0 string"
        df = c.spark.read.csv(path, schema=schema, header=header, quote='"', escape='"', enforceSchema=True)
        return Frame.of(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), text=True).renamed(names or ["f0"])
    n = max(len(names), 1)
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    if header:
        # the first line of every file: the first row of the block that begins it
        block = lines.select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("begins"), F.monotonically_increasing_id().alias("at"))
        heads = block.where("begins").groupBy("file").agg(F.min("at").alias("head"))
        numbered = block.join(heads, F.col("at") == F.col("head"), "left_anti").select("value", "at")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(toggled_fields(x) + [None] * n)[:n] for x in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(n)), b.column("at")], [*(f"c{i}" for i in range(n)), "at"])

    df = map_arrow(numbered, parse, ", ".join(f"c{i} string" for i in range(n)) + ", at long")
    return Frame.of(df, ["at"], text=True).put([F.col(f"c{i}") for i in range(n)], names or ["f0"])


@step("PropertyInput", source=True)
def property_input(ins: list[Frame], p: Params, c: Context) -> Frame:
    """key and value of each property line; a key given again replaces the one before."""
    found: dict[str, str] = {}
    with open(p.required("filePath"), encoding="latin-1") as f:
        text = re.sub(r"\\\r?\n[ \t]*", "", f.read())
    for line in text.splitlines():
        line = line.lstrip()
        if line and line[0] not in "#!":
            m = re.match(r"((?:\\.|[^\s=:\\])*)\s*[=:]?\s*(.*)", line, re.S)
            plain = lambda s: re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda x: chr(int(x[1][1:], 16)) if len(x[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), s)
            found[plain(m[1])] = plain(m[2])
    return Frame.of(c.spark.createDataFrame(list(found.items()), "key string, value string"), text=True)


@step("RowGenerator", source=True)
def row_generator(ins: list[Frame], p: Params, c: Context) -> Frame:
    values = p.indexed("field")
    df = c.spark.range(p.integer("rowLimit", 1)).select("id", *[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
    f = Frame.of(df, ["id"])
    names = p.items_of("fieldNames")
    return f.put([F.col(f"c{i + 1}") for i in range(len(values))], names if len(names) == len(values) else [f"f{i}" for i in range(len(values))])


@step("SystemInfo", source=True)
def system_info(ins: list[Frame], p: Params, c: Context) -> Frame:
    now, jvm = datetime.now(), c.spark.sparkContext._jvm
    row = (now.strftime("%Y-%m-%d"), now.strftime("%H:%M:%S"), platform.node(), jvm.System.getProperty("java.version"), platform.system(), platform.release())
    names = ("date", "time", "hostname", "java_version", "os_name", "os_version")
    return Frame.of(c.spark.createDataFrame([row], ", ".join(f"{n} string" for n in names)), text=True)


@step("GetFileNames", source=True)
def get_file_names(ins: list[Frame], p: Params, c: Context) -> Frame:
    folder = p.required("directory")
    rows = []
    for path in sorted(globbing.glob(os.path.join(globbing.escape(folder), p.text("glob", "*")))):
        s = os.stat(path)
        at = datetime.fromtimestamp(s.st_mtime, timezone.utc).isoformat().replace("+00:00", "Z")
        rows.append((os.path.abspath(path), os.path.basename(path), str(s.st_size), at))
    return Frame.of(c.spark.createDataFrame(rows, "path string, name string, size string, modified string"), text=True)


@step("RowsFromResult", source=True)
def rows_from_result(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The rows that RowsToResult of an earlier run in this context left; none without."""
    got = c.results.get("rows")
    return got if got is not None else Frame.of(c.spark.createDataFrame([], "f0 string"), text=True)


@step("MappingInput", source=True, narrow=True)
def mapping_input(ins: list[Frame], p: Params, c: Context) -> Frame:
    if ins:
        return ins[0]
    return c.mapping_input if c.mapping_input is not None else Frame.of(c.spark.createDataFrame([], "f0 string"), text=True)


@step("MappingOutput", narrow=True)
def mapping_output(ins: list[Frame], p: Params, c: Context) -> Frame:
    c.results["mapping"] = ins[0]
    return ins[0]


@step("RowsToResult", narrow=True)
def rows_to_result(ins: list[Frame], p: Params, c: Context) -> Frame:
    c.results["rows"] = ins[0]
    return ins[0]


@step("DetectEmptyStream", effect=True, narrow=True)
def detect_empty_stream(ins: list[Frame], p: Params, c: Context) -> Frame:
    c.results["empty"] = ins[0].df.isEmpty()
    return ins[0]


@step("WriteToLog", effect=True, narrow=True)
def write_to_log(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Logs all rows in order, a partition at a time, or the first `logLimit` of them if that is set; the rows pass on."""
    f = ins[0]
    subject = p.text("logSubject", "")
    rows = f.sorted().select(*f.fields())
    for r in rows.toLocalIterator() if not p.text("logLimit") else rows.take(p.integer("logLimit", 0)):
        c.log(f"{p.text('logLevel', 'INFO')} {subject}[{', '.join('null' if v is None else str(v) for v in r)}]")
    return f


def _headed(head: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    return run


@step("TextFileOutput", effect=True, narrow=True)
def text_file_output(ins: list[Frame], p: Params, c: Context) -> Frame:
    """One file, in order: written by a range sort and one writer; with partitioned=true a folder of parts, in parallel, each
    with the header if there is one."""
    f = ins[0]
    columns = [f.col(x) for x in p.items_of("outputCols")] or f.fields()
    names = p.items_of("fieldNames")
    parts = f.sorted().select(*[F.when(x.cast("string") != "", x.cast("string")).alias(f"v{i}") for i, x in enumerate(columns)])
    quoted = [F.when(F.col(v).rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit(""))) for v in parts.columns]
    lines = parts.select(F.concat_ws(",", *quoted).alias("value"))
    head = ",".join(n if not re.search('[,"\n]', n) else '"' + n.replace('"', '""') + '"' for n in names) if p.flag("writeHeader", False) and names else None
    path = p.required("filePath")
    if p.flag("partitioned", False):
        if head is not None:  # each part begins with it
            lines = map_arrow(lines, _headed(head), "value string")
        lines.write.mode("overwrite").text(path)
        return f
    target = urlparse(path).path if path.startswith("file:") else path
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    part = f"{target}.part"
    with open(part, "w", encoding="utf-8", newline="") as out:
        if head is not None:
            out.write(head + "\n")
        for r in lines.toLocalIterator(prefetchPartitions=True):  # a partition at a time
            out.write(r[0] + "\n")
    shutil.move(part, target)
    return f
