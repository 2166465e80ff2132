"""Exact percentiles per group of very large columns, from states that can be put together.

A state is a group's sorted values with their counts; states of days (or of any other parts) are merged by adding
counts, so percentiles of any choice of days are exact: the stated error is 0. The merged values are sorted as a whole by
(group, value) at sampled quantiles. Each partition is read batch by batch and counts its groups; a group that lies within
it is answered there, unless it has more than HELD values. The others, and those at a partition's edges, keep their values
with ranks in the partition, to which the offsets of the partitions before (a count for each of them) are added to find the
target positions and their neighbours. Positions and interpolation are those of integers and decimals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.core.runtime import sorted_scan

#: percentiles in percent
PERCENTILES = (50, 90, 95, 99)
#: so many values of one group a task keeps, at most, until it answers or passes them on
HELD = 1 << 20


def value_states(df: DataFrame, groups: list[str], value: str, once: list[str] | None = None, day: str | None = None) -> DataFrame:
    """Mergeable states: (groups, [day], value long, n).

    Null and negative values are left out. With `once`, rows that share groups and these columns count once, with their
    least value and, if `day` is named, on their earliest day. A null group is a group, and a null in
    `once` a value like others. Empty input: no state.
    """
    v = F.col(value).cast("long")
    own = df.where(v >= 0)
    days = [F.col(day).cast("timestamp_ntz").cast("date").alias("day")] if day else []
    own = own.select(*groups, *[F.col(c).alias(f"__once_{c}") for c in once or []], *days, v.alias("value"))
    if once is not None:
        own = own.groupBy(*groups, *[f"__once_{c}" for c in once if c not in groups]).agg(F.min("value").alias("value"), *([F.min("day").alias("day")] if day else []))
    return own.groupBy(*groups, *(["day"] if day else []), "value").agg(F.count(F.lit(1)).alias("n"))


def merge_states(states: DataFrame, groups: list[str]) -> DataFrame:
    """States of several days or parts as one; the error stays 0."""
    return states.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentile_name(p: int) -> str:
    return f"p{p}"


def percentiles(states: DataFrame, groups: list[str], ps: tuple[int, ...] = PERCENTILES, partitions: int | None = None, held: int = HELD) -> DataFrame:
    """(groups, n_rows, p50, p90, ..., max_error): percentiles by linear interpolation of neighbouring order statistics.

    `ps` are whole percents, so each result is a decimal with two places, and exact: max_error is 0. `states` has each
    (group, value) once, as `merge_states` gives it. Groups may be of any size: a group that holds a third of all values
    spans partitions, and no task keeps more than `held` values of it.
    """
    if any(p != int(p) or not 0 <= p <= 100 for p in ps):
        raise ValueError("percentiles are whole percents from 0 to 100")
    clash = {*groups} & {"n_rows", "max_error", *map(percentile_name, ps)}
    if clash:
        raise ValueError(f"a group can't be named {sorted(clash)}")
    keys = [f"g{i}" for i in range(len(groups))]
    own = states.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], "value", "n")
    kinds = dict(own.dtypes)
    ends = [f"{x}{i}" for i in range(len(ps)) for x in ("lo", "hi")]
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["kind string", "pid int", "edge int", "value long", "upto long", "n long"] + [f"{x} long" for x in ends])
    found = sorted_scan(own, [*keys, "value"], _scanner(keys, ps, held), schema, partitions)

    # groups at a partition's edges, at most two a partition, and those with more than `held` values
    state = found.where("kind = 'state'").select(*keys, "pid", "edge", "n")
    same = Window.partitionBy(*keys)
    before = same.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    state = state.withColumn("total", F.sum("n").over(same)).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*keys, F.col("pid").alias("sp"), F.col("edge").alias("se"), "total", "offset")
    kept = found.where("kind = 'value'").select("pid", "edge", "value", "upto", "n").join(F.broadcast(state), (F.col("pid") == F.col("sp")) & (F.col("edge") == F.col("se")))
    low, high = F.col("offset") + F.col("upto") - F.col("n"), F.col("offset") + F.col("upto")
    hit, picks = F.lit(False), []
    for i, p in enumerate(ps):
        at, rest = _position(p)
        one = (low <= at) & (at < high)
        next_ = at + (rest > 0).cast("long")
        two = (low <= next_) & (next_ < high)
        hit = hit | one | two
        picks += [F.max(F.when(one, F.col("value"))).alias(f"lo{i}"), F.max(F.when(two, F.col("value"))).alias(f"hi{i}")]
    edge = kept.where(hit).groupBy(*keys, "total").agg(*picks).withColumnRenamed("total", "n")
    every = found.where("kind = 'answer'").select(*keys, "n", *ends).unionByName(edge.select(*keys, "n", *ends)).withColumnRenamed("n", "total")
    names = [F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)] + [F.col("total").alias("n_rows")]
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    for i, p in enumerate(ps):
        rest = _position(p)[1].cast("int")
        hundredfold = exact(f"lo{i}") * (100 - rest) + exact(f"hi{i}") * rest
        names.append((hundredfold * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(21,2)").alias(percentile_name(p)))
    return every.select(*names, F.lit(0.0).alias("max_error"))


def _position(p: int):
    """Of percentile p among `total` values: the position before it, from 0 on, and the hundredths towards the next."""
    at = (F.col("total").cast("decimal(19,0)") - 1) * p
    rest = (at % 100).cast("long")
    return ((at - rest) / 100).cast("long"), rest


class _Open:
    """The group at the end of what was read: its values so far, unless they were passed on."""

    def __init__(self, key: tuple, edge: int | None):
        self.key, self.edge = key, edge
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.total = 0

    def add(self, value: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((value, n))
        self.size += len(value)


def _scanner(keys: list[str], ps: tuple[int, ...], held: int):
    ends = [f"{x}{i}" for i in range(len(ps)) for x in ("lo", "hi")]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, open_, edges, types = TaskContext.get().partitionId(), None, 0, None

        def rows(groups: list[pa.Array], size: int, kind: str, edge=None, value=None, upto=None, n=None, answers=None) -> pa.RecordBatch:
            cols = [*groups, pa.array([kind] * size, pa.string()), pa.array(np.full(size, pid), pa.int32()), pa.nulls(size, pa.int32()) if edge is None else pa.array(np.full(size, edge), pa.int32())]
            cols += [pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (value, upto, n, *(answers or [None] * len(ends)))]
            return pa.RecordBatch.from_arrays(cols, [*keys, "kind", "pid", "edge", "value", "upto", "n", *ends])

        def repeated(key: tuple, size: int) -> list[pa.Array]:
            return [pa.array([x] * size, t) for x, t in zip(key, types, strict=True)]

        def passed_on(g: _Open) -> Iterator[pa.RecordBatch]:
            """The values kept so far, with their ranks in this partition."""
            nonlocal edges
            if g.edge is None:
                g.edge, edges = edges, edges + 1
            for value, n in g.parts:
                yield rows(repeated(g.key, len(value)), len(value), "value", g.edge, value, g.total + np.cumsum(n), n)
                g.total += int(n.sum())
            g.parts, g.size = [], 0

        def closed(g: _Open) -> Iterator[pa.RecordBatch]:
            if g.edge is not None:
                yield from passed_on(g)
                yield rows(repeated(g.key, 1), 1, "state", g.edge, n=[g.total])
                return
            value, n = (np.concatenate([p[i] for p in g.parts]) for i in (0, 1))
            total = np.array([n.sum()])
            yield rows(repeated(g.key, 1), 1, "answer", n=total, answers=_answers(value, np.cumsum(n), np.zeros(1, np.int64), total, ps))

        for b in batches:
            m = b.num_rows
            if not m:
                continue
            columns = [b.column(k) for k in keys]
            types = [c.type for c in columns]
            value, n = b.column("value").to_numpy(), b.column("n").to_numpy()
            new = np.zeros(m, bool)
            for c in columns:
                code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            head = np.r_[0, np.flatnonzero(new)]
            tail = np.r_[head[1:], m]
            at = lambda i: tuple(c[int(i)].as_py() for c in columns)
            first = at(0)
            if open_ is None:
                open_, edges = _Open(first, 0), 1  # the partition's first group
            elif open_.key != first:
                yield from closed(open_)
                open_ = _Open(first, None)
            open_.add(value[: tail[0]], n[: tail[0]])
            if len(head) > 1:
                yield from closed(open_)
                inner = np.arange(1, len(head) - 1)
                if len(inner):
                    upto = np.cumsum(n)
                    base = (upto - n)[head[inner]]
                    total = upto[tail[inner] - 1] - base
                    groups = [c.take(pa.array(head[inner])) for c in columns]
                    yield rows(groups, len(inner), "answer", n=total, answers=_answers(value, upto, base, total, ps))
                open_ = _Open(at(head[-1]), None)
                open_.add(value[head[-1] :], n[head[-1] :])
            if open_.size > held:
                yield from passed_on(open_)
        if open_ is not None:
            if open_.edge is None:
                open_.edge = edges  # the partition's last group
            yield from closed(open_)

    return scan


def _answers(value: np.ndarray, upto: np.ndarray, base: np.ndarray, total: np.ndarray, ps: tuple[int, ...]) -> list[np.ndarray]:
    """The two values around each percentile of each group; groups begin after `base` values and hold `total`."""
    out = []
    for p in ps:
        whole, part = np.divmod(total - 1, 100)  # in two parts, so that no product overflows
        at, rest = np.divmod(part * p, 100)
        at = base + whole * p + at
        out += [value[np.searchsorted(upto, at, "right")], value[np.searchsorted(upto, at + (rest > 0), "right")]]
    return out


def duration_states(executions: DataFrame) -> DataFrame:
    """Daily states of duration_ms per project_id and status; a row repeated for an id and status counts once."""
    return value_states(executions, ["project_id", "status"], "duration_ms", ["id"], "created_at")


__all__ = ["PERCENTILES", "duration_states", "merge_states", "percentile_name", "percentiles", "value_states"]
