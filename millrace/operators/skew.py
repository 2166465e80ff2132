"""Per-key results where a few keys hold most rows.

Each task first adds up its rows by key, which takes the weight off hot keys. The partial states are range partitioned by
(key, secondary order) at sampled quantiles, so that a heavy key fills as many partitions as its states need and no task
gets more than its share. A partition, read batch by batch, merges the states of its keys and emits the keys that lie
within it; only the first and the last key of a partition may go on elsewhere. Their states, at most two a partition, are
stitched by key; no other key moves again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow, materialise, sorted_scan

#: so many rows a task adds up at once
_ROWS = 1 << 17
#: how states of each function are merged
_MERGED = {"count": "sum", "sum": "sum", "min": "min", "max": "max"}


def skewed_aggregate(df: DataFrame, keys: list[str], order: str, aggregates: dict[str, tuple[str, str | None]], partitions: int | None = None) -> DataFrame:
    """Aggregate by `keys`; `aggregates` names results with (function, column): count (of rows), sum, min or max.

    Null keys form groups of their own, repeated rows count each, an empty input gives no row; null values are left out, and
    a key without a value has null. Sums of whole numbers are bigint (an overflow is an error), of decimals decimals with 38
    digits, else double. Only the columns that are named take part, so further columns can't clash.
    """
    if unknown := {f for f, _ in aggregates.values()} - set(_MERGED):
        raise ValueError(f"unknown functions {sorted(unknown)}")
    k, a = [f"k{i}" for i in range(len(keys))], [f"a{i}" for i in range(len(aggregates))]
    how, states, results = [_MERGED[f] for f, _ in aggregates.values()], [], []
    for x, (f, c) in zip(a, aggregates.values(), strict=True):
        if f == "count":
            state, kind = F.lit(1), "bigint"
        else:
            state, kind = F.col(c), df.schema[c].dataType.simpleString()
        result = kind
        if f == "sum" and kind.startswith("decimal"):
            kind = result = f"decimal(38,{df.schema[c].dataType.scale})"
        elif f == "sum" and kind in ("float", "double"):
            kind = result = "double"
        elif f in ("sum", "count"):
            kind, result = "decimal(38,0)", "bigint"  # so that no sum wraps unseen
        states.append(state.cast(kind).alias(x))
        results.append(F.col(x).cast(result))
    rows = df.select(*[F.col(c).alias(x) for x, c in zip(k, keys, strict=True)], F.col(order).alias("o"), *states)
    partial = map_arrow(rows, _partial(k, a, how), ", ".join(f"{n} {t}" for n, t in rows.dtypes))
    found = sorted_scan(partial, [*k, "o"], _merge(k, a, how), ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "o") + ", edge boolean", partitions)
    edges = found.where("edge").groupBy(*k).agg(*[getattr(F, f)(x).cast(found.schema[x].dataType).alias(x) for x, f in zip(a, how, strict=True)])
    every = found.where("NOT edge").drop("edge").unionByName(edges)
    return every.select(*[F.col(x).alias(c) for x, c in zip(k, keys, strict=True)], *[x.alias(n) for x, n in zip(results, aggregates, strict=True)])


def _grouped(t: pa.Table, keys: list[str], values: list[str], how: list[str], order: list[str]) -> pa.RecordBatch:
    asked = [*zip(values, how, strict=True), *((o, "min") for o in order)]
    got = t.group_by(keys, use_threads=False).aggregate(asked)
    made = {c: f"{c}_{f}" for c, f in asked}
    names = [*keys, *order, *values]
    return pa.Table.from_arrays([got.column(made.get(c, c)).cast(t.schema.field(c).type) for c in names], names).combine_chunks().to_batches()[0]


def _partial(keys: list[str], values: list[str], how: list[str]):
    """The states of each key in every _ROWS rows of a task, with the least order among them."""
    most = _ROWS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= most:
                yield _grouped(pa.Table.from_batches(held), keys, values, how, ["o"])
                held, size = [], 0
        if size:
            yield _grouped(pa.Table.from_batches(held), keys, values, how, ["o"])

    return run


def _merge(keys: list[str], values: list[str], how: list[str]):
    """Finished keys of a partition, and the states of its first and last key."""
    names = [*keys, *values]

    def rows(b: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([edge] * b.num_rows, pa.bool_())], [*names, "edge"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = first = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(names)
            if first is None:
                first = [b.column(c)[0] for c in keys]
            last = [b.column(c)[b.num_rows - 1] for c in keys]
            g = _grouped(pa.Table.from_batches([b] if open_ is None else [open_, b]), keys, values, how, [])
            going_on = _are(g, keys, last)
            open_, done = g.filter(going_on), g.filter(pc.invert(going_on))
            edge = _are(done, keys, first)
            yield rows(done.filter(edge), True)
            yield rows(done.filter(pc.invert(edge)), False)
        if open_ is not None:
            yield rows(open_, True)

    return run


def _are(b: pa.RecordBatch, keys: list[str], key: list[pa.Scalar]) -> pa.Array:
    """Which rows have this key, null being equal to null."""
    out = pa.array(np.ones(b.num_rows, bool))
    for c, x in zip(keys, key, strict=True):
        v = b.column(c)
        out = pc.and_(out, pc.fill_null(pc.equal(v, x), False) if x.is_valid else pc.is_null(v))
    return out


def key_totals(df: DataFrame, fields: list[str], order: str, quantity: str, price: str, partitions: int | None = None) -> DataFrame:
    """Rows (field_name, key_value, n_rows, quantity, revenue) for the values of every field in `fields`.

    Ids are compared trimmed and in upper case; null ids are the key null. Null quantities and prices add nothing; a
    revenue that isn't finite counts as null. Revenue is summed as a decimal with six places, so it depends on no order.
    """
    amount = F.expr(f"try_cast(`{quantity}` * try_cast(`{price}` AS decimal(18,6)) AS decimal(28,6))")
    one = [F.struct(F.lit(f).alias("field_name"), F.upper(F.trim(F.col(f).cast("string"))).alias("key_value")) for f in fields]
    rows = df.select(F.explode(F.array(*one)).alias("k"), F.col(order).alias("o"), F.col(quantity).cast("long").alias("q"), amount.alias("a"))
    rows = rows.select("k.field_name", "k.key_value", "o", "q", "a")
    total = skewed_aggregate(rows, ["field_name", "key_value"], "o", {"n_rows": ("count", None), "quantity": ("sum", "q"), "revenue": ("sum", "a")}, partitions)
    return total.withColumn("revenue", F.col("revenue").cast("double"))


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """The keys of `key_totals` that hold at least `share` of all rows; rows with a null key count in the total."""
    totals = materialise(totals)  # read twice below
    # at most one row for each field, then at most 1/share rows for each
    all_rows = totals.groupBy("field_name").agg(F.sum("n_rows").alias("__all"))
    found = totals.join(F.broadcast(all_rows), "field_name").where((F.col("n_rows") >= F.lit(share) * F.col("__all")) & F.col("key_value").isNotNull())
    return found.select("field_name", "key_value")
