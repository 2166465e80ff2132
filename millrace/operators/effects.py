"""Steps that reach outside: files, processes, web requests.

Checks of the outside run row by row on the workers (Arrow batches); steps that change something run once, on the
driver, as tasks may be repeated.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow
from millrace.frame import Frame
from millrace.registry import Context, Params, step


def _per_row(f: Frame, columns: list[int], answer: Callable[..., tuple], names: list[str]) -> Frame:
    """Append `names`, which answer(values of columns) gives as texts."""
    n = len(names)
    order = f.keep()
    source = f.df.select(*f.fields(), *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(f"c{i}").cast(pa.string()).to_pylist() for i in columns), strict=True)
            got = [answer(*r) for r in rows]
            new = [pa.array([g[k] for g in got], pa.string()) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *(f"n{k}" for k in range(n))])

    schema = ", ".join(f"`{k}` {t}" for k, t in source.dtypes) + "".join(f", n{k} string" for k in range(n))
    g = Frame(map_arrow(source, run, schema), f.names, f.order, f.text)
    return g.append(*[F.col(f"n{k}") for k in range(n)], names=names)


def file_exists(path: str | None) -> tuple:
    return ("true" if path is not None and os.path.exists(path) else "false",)


def file_locked(path: str | None) -> tuple:
    import fcntl

    try:
        with open(path or "", "r+b") as f:
            fcntl.lockf(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            fcntl.lockf(f, fcntl.LOCK_UN)
        return ("false",)
    except OSError:
        return ("true",)


@step("FileExists")
def file_exists_step(ins: list[Frame], p: Params, c: Context) -> Frame:
    return _per_row(ins[0], [ins[0].index(p.text("column", "0"))], file_exists, ["exists"])


@step("FileLocked")
def file_locked_step(ins: list[Frame], p: Params, c: Context) -> Frame:
    return _per_row(ins[0], [ins[0].index(p.text("column", "0"))], file_locked, ["locked"])


class _Lines:
    def __init__(self, header: bool):
        self.header = header

    def __call__(self, path: str | None) -> tuple:
        try:
            with open(path or "", "rb") as f:
                n = sum(1 for _ in f)
            return (str(max(n - self.header, 0)),)
        except OSError:
            return (None,)


@step("GetFilesRowsCount")
def files_rows_count(ins: list[Frame], p: Params, c: Context) -> Frame:
    return _per_row(ins[0], [ins[0].index(p.text("column", "0"))], _Lines(p.flag("hasHeader", True)), ["rows"])


def shell(command: str | None) -> tuple:
    if command is None:
        return (None, "-1")
    try:
        done = subprocess.run(["/bin/sh", "-c", command], capture_output=True, text=True)
        return ((done.stdout.splitlines() or [None])[0], str(done.returncode))
    except OSError as e:
        return (str(e), "-1")


def allowed(c) -> None:
    if not c.allow_exec:
        raise PermissionError("running commands is off; set allow_exec on the context")


@step("ExecProcess")
def exec_process(ins: list[Frame], p: Params, c: Context) -> Frame:
    allowed(c)
    return _per_row(ins[0], [ins[0].index(p.text("commandColumn", "0"))], shell, ["output", "exit_code"])


class _Request:
    def __init__(self, url: str | None, method: str, timeout: float, body: bool):
        self.url, self.method, self.timeout, self.body = url, method, timeout, body

    def __call__(self, *row: str | None) -> tuple:
        values = list(row)
        url = self.url or values.pop(0)
        data = values[0].encode() if self.body and values[0] is not None else None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, method=self.method), timeout=self.timeout) as r:
                return r.read().decode("utf-8", "replace"), str(r.status)
        except urllib.error.HTTPError as e:
            return e.read().decode("utf-8", "replace"), str(e.code)
        except (OSError, ValueError, TypeError) as e:
            return str(e), "-1"


@step("Rest")
def rest(ins: list[Frame], p: Params, c: Context) -> Frame:
    f, url = ins[0], p.text("url")
    columns = ([] if url else [f.index(p.required("urlColumn"))]) + ([f.index(p["bodyColumn"])] if p.text("bodyColumn") else [])
    return _per_row(f, columns or [0], _Request(url, p.text("method", "GET").upper(), p.integer("timeoutMs", 5000) / 1000, bool(p.text("bodyColumn"))), ["body", "status"])


def _pairs(f: Frame, p: Params) -> Iterator[tuple]:
    columns = [f.col(p.text("sourceColumn", "0")).cast("string"), f.col(p.text("targetColumn", "1")).cast("string")]
    return f.sorted().select(*columns).toLocalIterator()


@step("ProcessFiles", effect=True, narrow=True)
def process_files(ins: list[Frame], p: Params, c: Context) -> Frame:
    """COPY, MOVE or DELETE, in order; the first failure stops the pipeline."""
    operation = p.text("operation", "COPY").upper()
    for source, target in _pairs(ins[0], p):
        if operation == "DELETE":
            os.remove(source)
        else:
            os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
            (shutil.copyfile if operation == "COPY" else shutil.move)(source, target)
    return ins[0]


@step("ZipFile", effect=True, narrow=True)
def zip_file(ins: list[Frame], p: Params, c: Context) -> Frame:
    for source, target in _pairs(ins[0], p):
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            z.write(source, os.path.basename(source))
    return ins[0]
