"""Session level helpers: shared storage for cut lineage, partition counts, time formatting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a range partition of a sorted scan holds about so many stored bytes
PARTITION_BYTES = 64 << 20
_written: dict[str, SparkSession] = {}
#: the lists of tables to remove at the end of the blocks that this thread of work is in
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only a local session may fall back to a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage and fixes the result of a sampled range partitioning, so that two readers see the same
    partitions. The table survives lost executors and is removed by `release`, at the end of a `scratch` block, or when the
    driver ends.
    """
    return materialise_batches(df.sparkSession, [df])


def materialise_batches(spark: SparkSession, batches: Iterable[DataFrame]) -> DataFrame:
    """One such table of all batches (one at least), which are written one after the other and needn't exist at once."""
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    _written[path] = spark
    for scope in _scopes.get():
        scope.append(path)
    for df in batches:
        df.write.mode("append").parquet(path)
        schema = df.schema
    out = spark.read.schema(schema).parquet(path)
    out._millrace_path = path
    return out


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of these bytes in the shared folder, which is removed like a materialised table."""
    folder = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    fs, p = _hadoop(spark, path)
    out = fs.create(p)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    _written[folder] = spark
    for scope in _scopes.get():
        scope.append(folder)
    return path


def release(*dfs: DataFrame) -> None:
    """Remove the tables behind results of `materialise` that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_millrace_path", None):
            _remove(path)


@contextmanager
def scratch():
    """Tables that are materialised inside are removed at the end: for runs whose results are written or fetched by then."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            _remove(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jvm is not None:
                _remove(path)
        except Exception:  # the session is gone already
            return


def ship_package(spark: SparkSession) -> None:
    """Give this package's code to the Python workers of all executors, once a session; Spark serves the file to them."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(root)
    folder = tempfile.mkdtemp(prefix=f"{package}-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{package}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for inside, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(inside, name)
                    z.write(full, os.path.join(package, os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._millrace_shipped = True


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, with the package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_scan(df: DataFrame, order: list, scan, schema, partitions: int | None = None) -> DataFrame:
    """Range partition df by `order` (sampled quantiles, so one hot key spans several partitions), sort, and run `scan`.

    `scan` gets the Arrow batches of one partition in order, and is to keep no more of them than it needs. Its result is
    materialised, as the partition ids that boundary states carry are only meaningful for this one run; so is its input, as
    sampling reads it once more. The partitions are as many as the input's size asks for, and at least
    spark.sql.shuffle.partitions.
    """
    own = materialise(df)
    fs, path = _hadoop(df.sparkSession, own._millrace_path)
    size = fs.getContentSummary(path).getLength()
    n = partitions or max(shuffle_partitions(df.sparkSession), -(-size // PARTITION_BYTES))
    out = materialise(map_arrow(own.repartitionByRange(n, *order).sortWithinPartitions(*order), scan, schema))
    release(own)
    return out


def iso_millis(c: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss.SSS` of a timestamp without zone; the session's zone plays no part."""
    s = c.cast("timestamp_ntz").cast("string")
    return F.substring(F.rpad(F.when(F.instr(s, ".") > 0, s).otherwise(F.concat(s, F.lit("."))), 26, "0"), 1, 23)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
