"""References to records that do not exist, or not at that time.

Parent keys are read as integers and compressed into contiguous runs; references are matched as of the preceding run
start, and a key beyond the run's end has no record at all. In the same pass each reference is matched as of the
records created before it, by the latest end among them. References, runs and records are range partitioned by (table,
key, time) in one sort, so a hot key spans partitions; what a border leaves open is settled from one state a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.core.runtime import map_arrow, sorted_scan

#: ids in a block of keys; a run ends at a block's border, which bounds the rows that are ranked together
BLOCK = 1 << 20
_FOREVER = np.iinfo(np.int64).max
_NEVER = np.iinfo(np.int64).min
_RUN, _RECORD, _REF = 0, 1, 2
_SCAN = "kind int, space string, n long, t long, ref_id {}, seen boolean, known boolean, upto long, pid int"


def integer_key(key: Column) -> tuple[Column, Column]:
    """(space, n), which together are the key, trimmed and in upper case: n is its last digits, up to 18 of them.

    The number of digits belongs to the space, so `C7` and `C007` differ.
    """
    k = F.upper(F.trim(key.cast("string")))
    digits = F.regexp_extract(k, r"([0-9]{1,18})\z", 1)
    space = F.concat(F.length(digits).cast("string"), F.lit("|"), F.substring(k, F.lit(1), F.length(k) - F.length(digits)))
    return space, F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def _micros(c: Column) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    c = c.cast("timestamp_ntz")
    day = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (F.extract(F.lit("second"), c) * 1_000_000).cast("long")


def contiguous_runs(keys: DataFrame) -> DataFrame:
    """Rows (space, n, upto) for the runs of neighbouring n in `keys` (space, n); no run crosses a block's border."""
    w = Window.partitionBy("space", F.expr(f"n div {BLOCK}")).orderBy("n")
    ranked = keys.distinct().select("space", "n", (F.col("n") - F.row_number().over(w)).alias("island"), F.expr(f"n div {BLOCK}").alias("block"))
    return ranked.groupBy("space", "block", "island").agg(F.min("n").alias("n"), F.max("n").alias("upto")).select("space", "n", "upto")


def orphan_references(refs: DataFrame, ref_id: str, ref_time: str, links: list[tuple[str, str, DataFrame, str, str, str]], partitions: int | None = None) -> DataFrame:
    """Rows (ref_id, ref_table, reason, ym) of references without a live record; distinct.

    `links`: (column of refs, name of the parent table, parent table, its key, created, deleted). A record lives from
    created on until before deleted (null: for ever). reason: `missing` without any record of that id, `late` if all
    were created later, else `deleted`. Null references and references without a time are left out; a record without a
    created time exists but never lives and counts as earlier. Ids are compared trimmed and in upper case; an empty id
    is an id. Only the columns that are named are read. A null `ref_id` is kept; it may have any type that can be sorted.
    """
    parts, records = [], []
    t = _micros(F.col(ref_time))
    for column, name, parent, key, created, deleted in links:
        space, n = integer_key(F.col(key))
        records.append(parent.where(F.col(key).isNotNull()).select(F.concat(F.lit(name + "|"), space).alias("space"), n.alias("n"), F.coalesce(_micros(F.col(created)), F.lit(_NEVER)).alias("t"), F.when(F.col(created).isNull(), F.lit(_NEVER)).otherwise(F.coalesce(_micros(F.col(deleted)), F.lit(_FOREVER))).alias("upto")))
        space, n = integer_key(F.col(column))
        parts.append(refs.where(F.col(column).isNotNull() & F.col(ref_time).isNotNull()).select(F.lit(_REF).alias("kind"), F.concat(F.lit(name + "|"), space).alias("space"), n.alias("n"), t.alias("t"), F.col(ref_id).alias("ref_id"), F.lit(_NEVER).alias("upto")))
    record = records[0]
    for r in records[1:]:
        record = record.unionByName(r)
    id_type = refs.schema[ref_id].dataType
    none, scanned = F.lit(None).cast(id_type), _SCAN.format(id_type.simpleString())
    record = record.groupBy("space", "n", "t").agg(F.max("upto").alias("upto"))
    runs = contiguous_runs(record.select("space", "n")).select(F.lit(_RUN).alias("kind"), "space", "n", F.lit(_NEVER).alias("t"), none.alias("ref_id"), "upto")
    every = runs.unionByName(record.select(F.lit(_RECORD).alias("kind"), "space", "n", "t", none.alias("ref_id"), "upto"))
    for p in parts:
        every = every.unionByName(p)
    # ref_id is in the order only to let the sampled quantiles split references of one key and time
    found = sorted_scan(every, ["space", "n", "t", "kind", "ref_id"], _scan, scanned, partitions)
    carry = F.broadcast(map_arrow(found.where(f"kind <> {_REF}").repartition(1), _carry, scanned).select(F.col("pid"), *[F.col(c).alias("c_" + c) for c in ("space", "n", "upto", "t", "known", "seen")]))  # a row a partition
    own = F.col("space").eqNullSafe(F.col("c_space"))
    same = own & (F.col("n") == F.col("c_n"))
    seen = F.col("seen") | F.coalesce(same & F.col("c_seen"), F.lit(False))
    upto = F.greatest("upto", F.when(same, F.col("c_upto")).otherwise(F.lit(_NEVER)))
    known = F.col("known") | seen | F.coalesce(own & (F.col("c_t") >= F.col("n")), F.lit(False))
    open_ = found.where(f"kind = {_REF}").join(carry, "pid", "left").where(upto <= F.col("t"))
    reason = F.when(~known, "missing").when(~seen, "late").otherwise("deleted")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / F.lit(86_400_000_000)).cast("int"))
    return open_.select("ref_id", F.substring_index("space", "|", 1).alias("ref_table"), reason.alias("reason"), F.substring(day.cast("string"), 1, 7).alias("ym")).distinct()


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References that no record seen in this partition keeps alive, and the partition's last run and record.

    It goes batch by batch; each batch is led by the last run and the last key's latest end of those before."""
    from pyspark import TaskContext

    pid, led, first, last = TaskContext.get().partitionId(), None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        b = b.select(["kind", "space", "n", "t", "ref_id", "upto"])
        if led is not None and led.num_rows:
            b = pa.Table.from_batches([led, b]).combine_chunks().to_batches()[0]
        space = b.column("space")
        code = space.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        kind, n, at, upto = (b.column(c).to_numpy() for c in ("kind", "n", "t", "upto"))
        m = len(kind)
        i = np.arange(m)
        group = np.cumsum(np.r_[True, (code[1:] != code[:-1]) | (n[1:] != n[:-1])]) - 1
        # the preceding run of the same space, and whether it reaches the key
        run = np.maximum.accumulate(np.where(kind == _RUN, i, -1))
        known = (run >= 0) & (code[run] == code) & (upto[run] >= n)
        # the latest end among the preceding records of the same key: a running maximum of ranks, lifted by the group
        record = kind == _RECORD
        ends, rank = np.unique(np.where(record, upto, _NEVER), return_inverse=True)
        lift = group * np.int64(len(ends) + 1)
        best = np.maximum.accumulate(np.where(record, lift + rank + 1, lift)) - lift
        seen = best > 0
        end = np.where(seen, ends[np.maximum(best, 1) - 1], _NEVER)
        dead = np.flatnonzero((kind == _REF) & (end <= at))
        ids = b.column("ref_id")
        if len(dead):
            yield _rows(kind[dead], space.take(pa.array(dead)), n[dead], at[dead], ids.take(pa.array(dead)), seen[dead], known[dead], end[dead], pid)
        key = (space[m - 1].as_py(), int(n[-1]))
        if first is None:
            first = (space[0].as_py(), int(n[0]))
        # what leads the next batch: the run, then the key's latest end
        k = [int(run[-1])] if run[-1] >= 0 else []
        ends_at = [_RUN] * len(k) + [_RECORD] * bool(seen[-1])
        at_row = [*k, *([m - 1] if seen[-1] else [])]
        led = pa.RecordBatch.from_arrays(
            [pa.array(ends_at, pa.int32()), space.take(pa.array(at_row, pa.int64())), pa.array(n[at_row], pa.int64()), pa.array([_NEVER] * len(at_row), pa.int64()), pa.nulls(len(at_row), ids.type), pa.array([*upto[k].tolist(), *([int(end[-1])] if seen[-1] else [])], pa.int64())], b.schema.names
        )
        last = (key, bool(seen[-1]), int(end[-1]), (space[k[0]].as_py(), int(n[k[0]]), int(upto[k[0]])) if k else None, ids.type)
    if last is None:
        return
    (own, number), was_seen, until, run_, kind_of_id = last
    yield _rows([_RECORD], pa.array([own], pa.string()), [number], [_NEVER], pa.nulls(1, kind_of_id), [was_seen], [first == (own, number)], [until], pid)
    if run_:
        yield _rows([_RUN], pa.array([run_[0]], pa.string()), [run_[1]], [run_[2]], pa.nulls(1, kind_of_id), [True], [True], [_NEVER], pid)


def _rows(kind, space, n, t, ref_id, seen, known, upto, pid) -> pa.RecordBatch:
    kind = np.asarray(kind)
    cols = [pa.array(kind, pa.int32()), space, pa.array(n, pa.int64()), pa.array(t, pa.int64()), ref_id, pa.array(seen, pa.bool_()), pa.array(known, pa.bool_()), pa.array(upto, pa.int64()), pa.array(np.full(len(kind), pid), pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "space", "n", "t", "ref_id", "seen", "known", "upto", "pid"])


def _carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each partition what the ones before it leave: the last run (its end in t) and the last key's records.

    A run and a key that matter for the first key of a partition share its space, so one row holds both.
    """
    read = list(batches)
    rows = sorted((r for b in read for r in b.to_pylist()), key=lambda r: (r["pid"], -r["kind"]))
    by: dict[int, list[dict]] = {}
    for r in rows:
        by.setdefault(r["pid"], []).append(r)
    run = key = None
    for pid in sorted(by):
        if key is not None:
            inside = run is not None and run["space"] == key["space"]
            yield _rows([_RECORD], pa.array([key["space"]]), [key["n"]], [run["t"] if inside else _NEVER], pa.nulls(1, read[0].column("ref_id").type), [key["seen"]], [inside], [key["upto"]], pid)
        for r in by[pid]:
            if r["kind"] == _RUN:
                run = r
            elif r["known"] and key is not None and (key["space"], key["n"]) == (r["space"], r["n"]):
                key = r | {"seen": r["seen"] or key["seen"], "upto": max(r["upto"], key["upto"])}
            else:
                key = r
