"""Schemas that drift between versions: every change, and all records in one consistent table.

Neighbouring versions are matched by similarity flooding. Both schemas become graphs: nodes are fields, types, the two
ends of each list of fields and the records that hold them; edges lead from a field to the next one, to its type and to the
record it is nested in. Pairs of nodes start with the similarity of their names; each takes in the scores of the pairs that
equal edges lead to, until nothing moves. The damping makes every round halve what still moves, so this ends without a cap.
From the scores, consistent correspondences are selected: a name that both versions have is its own counterpart, and each
other field has at most one, the pair being the best for both. Changes follow from the correspondences; of those between
different names the contract's positional rule counts as `renamed` only what also keeps its place and type.

`field_changes` compares two field lists, `version_changes` those of all feeds, `unite` casts the records of drifting
tables to unified types and unites them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.runtime import map_arrow, materialise, sorted_scan
from millrace.functions.definitions import xml_definition, xml_root

#: step types whose field list is the feed's input (fixed values)
INPUT_TYPES = ("CsvInput", "CSVInput", "TextFileInput", "ExcelInput")
#: the part of a pair's score that is its own, and of names that are alike but not equal; when scores count as settled
_OWN, _NAME_WEIGHT, _SETTLED = 0.5, 0.3, 1e-6
_VERSIONS = "id string, project_id string, feed string, created_at timestamp_ntz, names array<string>, types array<string>"
_CHANGES = "kind string, feed_key string, file_id string, field_name string, old_name string, old_type string, new_type string, pid int, names array<string>, types array<string>"


def feed_name(filename: Column) -> Column:
    """The file's name without directory, letter case, extension and marks of version, copy or date at its end."""
    name = F.lower(F.regexp_replace(filename, r"^.*[/\\]", ""))
    name = F.trim(F.regexp_replace(name, r"\.[a-z]+$", ""))
    mark = r"[ ._-]*\([0-9]+\)|[ ._-]+(?:v|ver|version|rev|r)[ ._-]?[0-9]+|[ ._-]+copy(?:[ ._-]*[0-9]+)?|[ ._-]+[0-9]{4}[-._]?[0-9]{2}[-._]?[0-9]{2}"
    return F.regexp_replace(name, f"(?:{mark})+$", "")


def declared_fields(content: bytes | None) -> tuple[list[str], list[str]] | None:
    """Names in lower case and types of the first input step; None if the file is not well formed.

    A file without an input step declares no field. A name given twice counts once, with its first type.
    """
    root = xml_root(content)
    if root is None:
        return None
    d = xml_definition(root)
    names: dict[str, str] = {}
    for part in d["parts"] if d else ():
        if part["kind"] == "step" and part["type"] in INPUT_TYPES:
            for n, k in part["fields"]:
                names.setdefault(n.lower(), (k or "String").lower())
            break
    return list(names), list(names.values())


def feed_versions(files: DataFrame) -> DataFrame:
    """(id, project_id, feed, created_at, names, types) of all well-formed transformation files."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [declared_fields(x) for x in b.column("content").to_pylist()]
            keep = pa.array([i for i, x in enumerate(got) if x is not None], pa.int64())
            cols = [b.column(c).take(keep) for c in ("id", "project_id", "feed", "created_at")]
            cols += [pa.array([x[k] for x in got if x is not None], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "project_id", "feed", "created_at", "names", "types"])

    ktr = files.where(F.upper("file_type") == "KTR")
    own = ktr.select(F.col("id").cast("string").alias("id"), F.col("project_id").cast("string").alias("project_id"), feed_name(F.col("filename")).alias("feed"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("content").cast("binary").alias("content"))
    return map_arrow(own, read, _VERSIONS)


@lru_cache(1 << 16)
def _alike(a: str, b: str) -> float:
    return 1.0 if a == b else _NAME_WEIGHT * SequenceMatcher(None, a, b, False).ratio()


def flood(old: list[str], old_types: list[str], new: list[str], new_types: list[str], old_parents: list[int] | None = None, new_parents: list[int] | None = None) -> np.ndarray:
    """Scores (old x new) of all pairs of fields after similarity flooding.

    `old_parents`, `new_parents`: the position of the record a field is nested in, -1 (the default) for the outermost.
    Fields follow each other within their record. A pair's score is half its name's similarity and half the mean of what
    flows in: the pair before and the pair after (the ends of a list are a pair of their own, ends and fields none), the
    pair of the types, and the pair of the records. Types and records are scored likewise, from the best of their fields.
    Every flow is a mean or a maximum, so a round moves no score by more than half of what moved before.
    """
    n, m = len(old), len(new)
    if not n or not m:
        return np.zeros((n, m))
    up, up2 = np.array(old_parents or [-1] * n), np.array(new_parents or [-1] * m)
    own = np.array([[_alike(a, b) for b in new] for a in old])
    kinds, kinds2 = sorted(set(old_types)), sorted(set(new_types))
    kind, kind2 = np.array([kinds.index(t) for t in old_types]), np.array([kinds2.index(t) for t in new_types])
    same = np.array([[float(a == b) for b in kinds2] for a in kinds])
    (before, after), (before2, after2) = _neighbours(up), _neighbours(up2)
    sides = [(np.maximum(x, 0)[:, None], np.maximum(y, 0)[None, :], ((x[:, None] >= 0) & (y[None, :] >= 0)).astype(float), ((x[:, None] < 0) & (y[None, :] < 0)).astype(float)) for x, y in ((before, before2), (after, after2), (up, up2))]
    inside = sides[2][2] > 0
    holders = (np.broadcast_to(up[:, None], (n, m))[inside], np.broadcast_to(up2[None, :], (n, m))[inside])
    has = np.isin(np.arange(n), up)[:, None] & np.isin(np.arange(m), up2)[None, :]
    by_kind = (np.repeat(kind, m), np.tile(kind2, n))
    s, t, root = own, same, 1.0
    while True:
        # the ends of two lists are alike, an end and a field aren't; the outermost records are a pair of their own
        flow = (sum(s[x, y] * within + alike * (root if i == 2 else 1.0) for i, (x, y, within, alike) in enumerate(sides)) + t[kind[:, None], kind2[None, :]]) / 4
        if has.any():
            nested = np.zeros_like(s)  # the best pair of fields within two records
            np.maximum.at(nested, holders, s[inside])
            flow = np.where(has, (4 * flow + nested) / 5, flow)
        best = np.zeros_like(t)
        np.maximum.at(best, by_kind, s.ravel())
        next_, next_t, next_root = _OWN * own + (1 - _OWN) * flow, _OWN * same + (1 - _OWN) * best, _OWN + (1 - _OWN) * s.max()
        moved = max(np.abs(next_ - s).max(), np.abs(next_t - t).max(), abs(next_root - root))
        s, t, root = next_, next_t, next_root
        if moved < _SETTLED:
            return s


def _neighbours(parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field before and after each one within its record; -1 at the ends."""
    before, after, last = np.full(len(parents), -1), np.full(len(parents), -1), {}
    for i, p in enumerate(parents.tolist()):
        if p in last:
            before[i], after[last[p]] = last[p], i
        last[p] = i
    return before, after


def correspondences(old: list[str], old_types: list[str], new: list[str], new_types: list[str], old_parents: list[int] | None = None, new_parents: list[int] | None = None) -> list[tuple[int, int]]:
    """The selected pairs: names that both have, and of the others those that are the best for each other.

    Among the others, pairs are taken by falling score (ties: by position), each field once. A pair stands only if both
    fields have no better one left, which taking them in this order makes sure of.
    """
    path = lambda names, parents: [_path(names, parents, i) for i in range(len(names))]
    a, b = path(old, old_parents), path(new, new_parents)
    at = {x: j for j, x in enumerate(b)}
    pairs = [(i, at[x]) for i, x in enumerate(a) if x in at]
    gone, come = [i for i, x in enumerate(a) if x not in at], [j for j, x in enumerate(b) if x not in set(a)]
    if not gone or not come:
        return pairs
    s = flood(old, old_types, new, new_types, old_parents, new_parents)
    left, right = set(gone), set(come)
    for _, i, j in sorted((-round(s[i, j], 5), i, j) for i in gone for j in come):
        if i in left and j in right:
            pairs.append((i, j))
            left.discard(i)
            right.discard(j)
    return pairs


def _path(names: list[str], parents: list[int] | None, i: int) -> tuple[str, ...]:
    out = [names[i]]
    while parents and parents[i] >= 0:
        i = parents[i]
        out.insert(0, names[i])
    return tuple(out)


def field_changes(old: list[str], old_types: list[str], new: list[str], new_types: list[str]) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(kind, field, old name, old type, new type) of every change between two field lists."""
    if old == new and old_types == new_types:
        return []
    pairs = correspondences(old, old_types, new, new_types)
    shared = {old[i] for i, j in pairs if old[i] == new[j]}
    out = [("retyped", old[i], None, old_types[i], new_types[j]) for i, j in pairs if old[i] == new[j] and old_types[i] != new_types[j]]

    def slots(names: list[str]) -> dict:
        found, left, between = {}, "", []
        for k, x in enumerate(names):
            if x in shared:
                found[left, x] = between
                left, between = x, []
            else:
                between.append(k)
        found[left, ""] = between
        return found

    before, after = slots(old), slots(new)
    place = {tuple(v): after.get(k) for k, v in before.items() if len(v) == 1}
    gone, come = set(), set()
    for i, j in pairs:
        if old[i] != new[j] and place.get((i,)) == [j] and old_types[i] == new_types[j]:
            out.append(("renamed", new[j], old[i], old_types[i], new_types[j]))
            gone.add(i)
            come.add(j)
    out += [("removed", a, None, old_types[i], None) for i, a in enumerate(old) if a not in shared and i not in gone]
    out += [("added", b, None, None, new_types[j]) for j, b in enumerate(new) if b not in shared and j not in come]
    return out


def _changes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "feed_key", "file_id", "field_name", "old_name", "old_type", "new_type", "pid", "names", "types"])


def _compare(key: str, file_id: str, a: tuple, b: tuple) -> list[tuple]:
    return [(kind, key, file_id, f, o, t, u, None, None, None) for kind, f, o, t, u in field_changes(*a, *b)]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes between neighbours within the partition, and its first and last version."""
    from pyspark import TaskContext

    pid, last = TaskContext.get().partitionId(), None
    for b in batches:
        out = []
        for key, file_id, names, types in zip(*(b.column(c).to_pylist() for c in ("feed_key", "id", "names", "types")), strict=True):
            now = (names, types)
            if last is None:
                out.append(("head", key, file_id, None, None, None, None, pid, names, types))
            elif last[0] == key:
                out += _compare(key, file_id, last[2], now)
            last = (key, file_id, now)
        yield _changes(out)
    if last is not None:
        yield _changes([("tail", last[0], last[1], None, None, None, None, pid, *last[2])])


def _stitch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["pid"], r["kind"]))
    out, last = [], None
    for r in rows:
        if r["kind"] == "tail":
            last = r
        elif last is not None and last["feed_key"] == r["feed_key"]:
            out += _compare(r["feed_key"], r["file_id"], (last["names"], last["types"]), (r["names"], r["types"]))
    yield _changes(out)


def version_changes(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every change between neighbouring versions: (kind, feed_key, file_id, field_name, old_name, old_type, new_type).

    Versions are ordered by created_at (null first), then id. They are range partitioned by (feed, time), so a feed with
    very many versions spans partitions; the neighbours at borders are compared from two rows a partition.
    """
    keyed = versions.select(F.concat_ws("|", F.length("project_id").cast("string"), "project_id", F.lit("/"), "feed").alias("feed_key"), "created_at", "id", "names", "types")
    found = sorted_scan(keyed, ["feed_key", "created_at", "id"], _scan, _CHANGES, partitions)
    border = map_arrow(found.where("kind IN ('head', 'tail')").repartition(1), _stitch, _CHANGES)
    out = ["kind", "feed_key", "file_id", "field_name", "old_name", "old_type", "new_type"]
    return found.where("kind NOT IN ('head', 'tail')").select(out).unionByName(border.select(out))


def feed_changes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct (file_id, change_kind, field_name) over all feeds of all projects. Null and damaged files are no
    versions; repeated uploads give no change; an empty table gives no row."""
    changes = version_changes(materialise(feed_versions(files)), partitions)
    return changes.select("file_id", F.col("kind").alias("change_kind"), "field_name").distinct()


def unified_fields(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """One consistent table of all declared fields of all versions.

    (file_id, project_id, feed, field_position, field_name, declared_type, unified_type, renamed_to): unified_type is
    the type that all versions' types of that field can be cast to, renamed_to the name a later version gave it last.
    """
    versions = materialise(feed_versions(files))
    fields = versions.select(F.col("id").alias("file_id"), "project_id", "feed", F.posexplode(F.arrays_zip("names", "types")).alias("p", "f")).select("file_id", "project_id", "feed", (F.col("p") + 1).alias("field_position"), F.col("f.names").alias("field_name"), F.col("f.types").alias("declared_type"))
    # types form a handful of values, so a feed's set of them is small
    types = fields.groupBy("project_id", "feed", "field_name").agg(F.sort_array(F.collect_set("declared_type")).alias("seen"))
    numeric = F.size(F.array_except("seen", F.array(*map(F.lit, ("integer", "number", "bignumber"))))) == 0
    unified = F.when(F.size("seen") == 1, F.col("seen")[0]).when(numeric, F.when(F.array_contains("seen", "bignumber"), "bignumber").otherwise("number")).otherwise("string")
    types = types.select(F.col("project_id").alias("tp"), F.col("feed").alias("tf"), F.col("field_name").alias("tn"), unified.alias("unified_type"))
    renames = version_changes(versions, partitions).where("kind = 'renamed'").join(versions.select(F.col("id").alias("file_id"), "project_id", "feed", "created_at"), "file_id")
    renames = renames.groupBy(F.col("project_id").alias("rp"), F.col("feed").alias("rf"), F.col("old_name").alias("rn")).agg(F.max_by("field_name", F.struct("created_at", "file_id")).alias("renamed_to"))
    eq = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    out = fields.join(types, eq("project_id", "tp") & eq("feed", "tf") & eq("field_name", "tn"), "left")
    out = out.join(renames, eq("project_id", "rp") & eq("feed", "rf") & eq("field_name", "rn"), "left")
    return out.select("file_id", "project_id", "feed", "field_position", "field_name", "declared_type", "unified_type", "renamed_to")


#: pairs of different names in tables are one column from this score on: both neighbours and the type agree, or one of the
#: neighbours, the type and most of the name
_MATCHED = 0.45
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def unified_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that values of both can be cast to: the wider number, the timestamp for dates, else string. Whole numbers
    beside doubles become doubles, which are exact up to 2^53."""
    x, y = a.simpleString(), b.simpleString()
    if x == y:
        return a
    if x in _WHOLE and y in _WHOLE:
        return max(a, b, key=lambda t: _WHOLE.index(t.simpleString()))
    if {x, y} <= {*_WHOLE, "float", "double"}:
        return T.DoubleType()
    digits = {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0)}
    size = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else digits.get(t.simpleString()) for t in (a, b)]
    if all(size):
        scale = max(q for _, q in size)
        whole = max(p - q for p, q in size)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if {x, y} <= {"date", "timestamp", "timestamp_ntz"}:
        return a if y == "date" else b if x == "date" else T.TimestampType()
    return T.StringType()


def _schema_graph(schema: T.StructType) -> tuple[list[str], list[str], list[int], list[T.DataType]]:
    """Names in lower case, types, records they are nested in, and data types of all fields, records included."""
    names, kinds, parents, types = [], [], [], []

    def walk(fields: T.StructType, parent: int) -> None:
        for f in fields:
            names.append(f.name.lower())
            kinds.append("struct" if isinstance(f.dataType, T.StructType) else f.dataType.simpleString())
            parents.append(parent)
            types.append(f.dataType)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, len(names) - 1)

    walk(schema, -1)
    return names, kinds, parents, types


def unite(versions: list[tuple[str, DataFrame]], version: str = "version") -> tuple[DataFrame, list[tuple[str, str, str, str | None, str | None, str | None]]]:
    """(one table of all records, changes) of tables whose schemas drift, in order.

    Neighbouring schemas are matched by flooding; fields that correspond are one column, which has the last of their names
    and the type that all of theirs can be cast to. Fields of nested records become columns named by their path (`a_b`);
    fields that a version lacks are null. Names are compared without letter case; a field that comes back under its name
    is the same column. The column `version` (or `_version`, where a field has that name) tells which table a record is
    from. changes: (version, kind, name, old name, old type, new type), kind being added, removed, renamed or retyped.
    Repeated records stay; a table without rows adds its columns only.
    """
    columns: list[dict] = []  # name, type
    at: list[dict[int, int]] = []  # of each version: field -> column
    changes: list[tuple] = []
    last = None
    for label, df in versions:
        names, kinds, parents, types = graph = _schema_graph(df.schema)
        paths = ["_".join(_path(names, parents, i)) for i in range(len(names))]
        own: dict[int, int] = {}
        if last is not None:
            was, old_paths, (o_names, o_kinds, o_parents, o_types) = last
            s = flood(o_names, o_kinds, names, kinds, o_parents, parents)
            for i, j in correspondences(o_names, o_kinds, names, kinds, o_parents, parents):
                same = old_paths[i] == paths[j]
                if i in was and kinds[j] != "struct" and (same or s[i, j] >= _MATCHED and unified_type(o_types[i], types[j]).simpleString() != "string" or s[i, j] >= _MATCHED and o_kinds[i] == kinds[j]):
                    own[j] = was[i]
                    if not same:
                        changes.append((label, "renamed", paths[j], old_paths[i], o_kinds[i], kinds[j]))
                    if o_kinds[i] != kinds[j]:
                        changes.append((label, "retyped", paths[j], old_paths[i], o_kinds[i], kinds[j]))
            changes += [(label, "removed", old_paths[i], old_paths[i], o_kinds[i], None) for i, c in was.items() if c not in own.values()]
        for j, path in enumerate(paths):
            if kinds[j] == "struct":
                continue
            if j not in own:
                back = [c for c, x in enumerate(columns) if x["name"] == path and c not in own.values()]
                own[j] = back[0] if back else len(columns)
                if not back:
                    columns.append({"name": path, "type": types[j]})
                if last is not None:
                    changes.append((label, "added", path, None, None, kinds[j]))
            x = columns[own[j]]
            x["name"], x["type"] = path, unified_type(x["type"], types[j])
        at.append(own)
        last = own, paths, graph
    taken: list[str] = []
    for x in columns:
        while x["name"] in taken:
            x["name"] = "_" + x["name"]
        taken.append(x["name"])
    while version.lower() in taken:
        version = "_" + version
    parts = []
    for (label, df), own in zip(versions, at, strict=True):
        names, _, parents, _ = _schema_graph(df.schema)
        real = _real_paths(df.schema)
        field = {c: j for j, c in own.items()}
        parts.append(df.select(F.lit(label).alias(version), *[(F.col(real[field[c]]) if c in field else F.lit(None)).cast(x["type"]).alias(x["name"]) for c, x in enumerate(columns)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out, changes


def _real_paths(schema: T.StructType, before: str = "") -> list[str]:
    out = []
    for f in schema:
        path = f"{before}`{f.name.replace('`', '``')}`"
        out.append(path)
        if isinstance(f.dataType, T.StructType):
            out += _real_paths(f.dataType, path + ".")
    return out


def read_versions(spark: SparkSession, paths: list[str], format_: str = "parquet", **options) -> list[tuple[str, DataFrame]]:
    """(first path, table) of each stretch of files with one schema, in the order of `paths`: the versions for `unite`. Only
    schemas come to the driver; files that share one are read together, so the plan grows with the drift alone."""
    out: list[tuple[list[str], T.StructType]] = []
    for path in paths:
        schema = spark.read.format(format_).options(**options).load(path).schema
        if out and out[-1][1] == schema:
            out[-1][0].append(path)
        else:
            out.append(([path], schema))
    return [(ps[0], spark.read.format(format_).options(**options).schema(schema).load(ps)) for ps, schema in out]
