"""Continuous periods and gaps of overlapping intervals per entity.

Starts and ends are sorted independently of each other. A gap lies where the start of rank i+1 exceeds the end of rank
i; the boundaries of neighbouring gaps, paired, give the periods. Ranks are counted within range partitions of
(entity, time), so an entity may span any number of partitions: its first rank there depends on how many intervals are
open at the partition's border. The scan goes batch by batch with a state of one row. It assumes the least number of open
intervals that it has met so far, marks what depends on it with that number, and emits a state of at most two rows a
partition, from which the true number, and what spans borders, is stitched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow, sorted_scan

_TS = pa.timestamp("us")
_SCAN = "kind string, entity string, from_time timestamp_ntz, to_time timestamp_ntz, pid int, bound boolean, bal long, dmin long, lead timestamp_ntz, last_end timestamp_ntz, firm boolean"
_NONE = np.iinfo(np.int64).min


def merged_intervals(df: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Rows (kind, entity, from_time, to_time): kind `period` or `gap`, times without zone.

    Intervals with a null time, or whose end is not after their start, are left out. Intervals that touch belong to one
    period. A null entity is an entity of its own. Repeated intervals count as one; an empty input gives no row; further
    columns are ignored.
    """
    s, e = F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz")
    own = df.select(F.col(entity).cast("string").alias("entity"), s.alias("s"), e.alias("e")).where("e > s")
    points = own.select("entity", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("ns"), F.lit(0).alias("ne")), F.struct(F.col("e").alias("t"), F.lit(0).alias("ns"), F.lit(1).alias("ne")))).alias("p"))
    # the sort's unit is one instant of an entity, so ties are never split between partitions
    points = points.groupBy("entity", F.col("p.t").alias("t")).agg(F.sum("p.ns").alias("ns"), F.sum("p.ne").alias("ne"))
    found = sorted_scan(points, ["entity", "t"], _scan, _SCAN, partitions)
    border = map_arrow(found.where("kind = 'state'").repartition(1), _stitch, _SCAN)
    out = ["kind", "entity", "from_time", "to_time"]
    sure = found.where("kind <> 'state' and not bound").select(out)
    # at most one row a partition
    firm = F.broadcast(border.where("kind = 'firm'").select("pid", "dmin"))
    held = found.where("kind <> 'state' and bound").join(firm, ["pid", "dmin"]).select(out)
    return sure.unionByName(held).unionByName(border.where("kind <> 'firm'").select(out))


_KINDS = {"kind": pa.string(), "entity": pa.string(), "from_time": _TS, "to_time": _TS, "pid": pa.int32(), "bound": pa.bool_(), "bal": pa.int64(), "dmin": pa.int64(), "lead": _TS, "last_end": _TS, "firm": pa.bool_()}


def _rows(n: int, **columns) -> pa.RecordBatch:
    """n rows of the scan's schema; single values stand for all rows, numbers in time columns are microseconds."""

    def array(v, kind: pa.DataType) -> pa.Array:
        if v is None or isinstance(v, pa.Array):
            return pa.nulls(n, kind) if v is None else v
        if kind == _TS:
            v = np.broadcast_to(np.asarray(v, np.int64), n)
            return pa.array(v, pa.int64(), mask=v == _NONE).cast(_TS)
        return pa.array([v] * n if isinstance(v, str | bool) else np.broadcast_to(np.asarray(v), n), kind)

    return pa.RecordBatch.from_arrays([array(columns.get(k), t) for k, t in _KINDS.items()], list(_KINDS))


@dataclass
class _Open:
    """The entity at the end of what was read, in this partition: intervals begun less ended, the least of that, the last
    end, and of the gaps at that least: the first one's ends, and where the period after the last one began."""

    entity: str | None
    bound: bool  # the partition's first entity, which may have begun before
    balance: int = 0
    least: int = 0
    last_end: int = _NONE
    first_from: int = _NONE
    first_to: int = _NONE
    since: int = _NONE
    level: int = 0

    def state(self, pid: int) -> pa.RecordBatch:
        firm = self.since != _NONE and self.level == -self.least
        ends = (self.first_from, self.first_to, self.since) if firm else (_NONE, _NONE, _NONE)
        return _rows(1, kind="state", entity=pa.array([self.entity], pa.string()), from_time=ends[0], to_time=ends[1], pid=pid, bound=self.bound, bal=self.balance, dmin=-self.least, lead=ends[2], last_end=self.last_end, firm=firm)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    pid, open_ = TaskContext.get().partitionId(), None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        names = b.column("entity")
        code = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        at = b.column("t").cast(pa.int64()).to_numpy()
        ns, ne = b.column("ns").to_numpy(), b.column("ne").to_numpy()
        new = np.r_[True, code[1:] != code[:-1]]
        g = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], n] - 1
        entity = names[0].as_py()
        if open_ is None:
            open_ = _Open(entity, True)
        elif open_.entity != entity:
            yield from _closed(open_, pid)
            open_ = _Open(entity, False)

        # ranks of starts and ends within the entity, the first entity's going on from what was read before
        begun, ended = np.cumsum(ns), np.cumsum(ne)
        begun -= (begun[head] - ns[head])[g]
        ended -= (ended[head] - ne[head])[g]
        balance = begun - ended
        own = slice(0, tail[0] + 1)
        balance[own] += open_.balance
        before = balance - ns + ne
        least = np.zeros(n, np.int64)
        if open_.bound:
            least[own] = np.minimum.accumulate(np.minimum(np.r_[open_.least, balance[own][:-1]], open_.least))
        # the end before each instant: the end of the current rank, where none is open
        spot = np.maximum.accumulate(np.where(ne > 0, np.arange(n), -1))
        spot = np.r_[-1, spot[:-1]]
        end = np.where(spot >= head[g], at[np.maximum(spot, 0)], _NONE)
        end[own] = np.where(spot[own] >= 0, end[own], open_.last_end)
        # the start of the next rank exceeds the end of the current rank where all that began have ended
        c = np.flatnonzero((ns > 0) & (before == least))
        group, gap_from, gap_to, level = g[c], end[c], at[c], -least[c]

        bound = open_.bound
        take = lambda i: names.take(pa.array(head[i]))
        one = np.flatnonzero(gap_from != _NONE)
        if len(one):
            yield _rows(len(one), kind="gap", entity=take(group[one]), from_time=gap_from[one], to_time=gap_to[one], pid=pid, bound=bound & (group[one] == 0), dmin=level[one])
        # neighbouring gaps, paired, give the periods; the last gap of the batch before comes first
        pg, pf, pt, pl = group, gap_from, gap_to, level
        if open_.since != _NONE:
            pg, pf, pt, pl = np.r_[0, group], np.r_[_NONE, gap_from], np.r_[open_.since, gap_to], np.r_[open_.level, level]
        pair = np.flatnonzero((pg[1:] == pg[:-1]) & (pl[1:] == pl[:-1]))
        if len(pair):
            yield _rows(len(pair), kind="period", entity=take(pg[pair]), from_time=pt[pair], to_time=pf[pair + 1], pid=pid, bound=bound & (pg[pair] == 0), dmin=pl[pair])

        last_end = np.full(len(head), _NONE)
        ends = np.flatnonzero(ne > 0)
        np.maximum.at(last_end, g[ends], at[ends])
        since = np.full(len(head), _NONE)
        since[group] = gap_to  # the last one stays
        # whole entities within the batch
        whole = np.arange(1, len(head) - 1)
        if len(whole):
            yield _rows(len(whole), kind="period", entity=take(whole), from_time=since[whole], to_time=last_end[whole], pid=pid, bound=False, dmin=0)

        first = np.flatnonzero(group == 0)
        if len(first):
            if open_.since == _NONE or open_.level != level[first[-1]]:
                lead = first[level[first] == level[first[-1]]][0]
                open_.first_from, open_.first_to = int(gap_from[lead]), int(gap_to[lead])
            open_.since, open_.level = int(gap_to[first[-1]]), int(level[first[-1]])
        open_.balance = int(balance[tail[0]])
        open_.least = min(int(least[tail[0]]), open_.balance) if bound else 0
        open_.last_end = max(open_.last_end, int(last_end[0]))
        if len(head) > 1:
            yield from _closed(open_, pid)
            k = len(head) - 1
            mine = np.flatnonzero(group == k)
            open_ = _Open(names[int(head[k])].as_py(), False, int(balance[-1]), 0, int(last_end[k]), _NONE, int(gap_to[mine[0]]), int(since[k]), 0)
    if open_ is not None:
        yield open_.state(pid)


def _closed(open_: _Open, pid: int) -> Iterator[pa.RecordBatch]:
    """An entity that ends in this partition: its last period, or its state if it may have begun before."""
    if open_.bound:
        yield open_.state(pid)
    else:
        yield _rows(1, kind="period", entity=pa.array([open_.entity], pa.string()), from_time=open_.since, to_time=open_.last_end, pid=pid, bound=False, dmin=0)


def _stitch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of all partitions, at most two each, in the order of the range partitioning."""
    rows = [r for b in batches for r in b.cast(b.schema).to_pylist()]
    rows.sort(key=lambda r: (r["pid"], not r["bound"]))
    out: list[tuple] = []
    entity, live, depth, since, last = None, False, 0, None, None

    def close():
        if live and since is not None:
            out.append(("period", entity, since, last, None, None))

    for r in rows:
        if not live or r["entity"] != entity:
            close()
            entity, live, depth, since, last = r["entity"], True, 0, None, None
        if r["firm"] and depth == r["dmin"]:
            if r["bound"]:
                out.append(("firm", None, None, None, r["pid"], r["dmin"]))
            ended = r["from_time"] or last
            if since is not None:
                out.append(("period", entity, since, ended, None, None))
                if r["from_time"] is None:
                    out.append(("gap", entity, ended, r["to_time"], None, None))
            since = r["lead"]
        depth += r["bal"]
        last = max((x for x in (last, r["last_end"]) if x is not None), default=None)
    close()
    if out:
        kind, ent, a, b, pid, level = zip(*out, strict=True)
        yield _rows(len(out), kind=pa.array(kind, pa.string()), entity=pa.array(ent, pa.string()), from_time=pa.array(a, _TS), to_time=pa.array(b, _TS), pid=pa.array(pid, pa.int32()), dmin=pa.array(level, pa.int64()))
