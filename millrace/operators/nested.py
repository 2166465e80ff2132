"""Deeply nested records to related flat tables, by the offsets of Arrow lists.

A list column is flattened as a whole: its values are the child rows, the parent-index kernel gives each child its
parent's position, and keys move down by one vectorised take. No row is visited. `child_table` does this for nested
DataFrame columns; `definition_tables` for pipeline definitions, whose texts are first read into nested Arrow arrays, the
conditions one array a level, as deep as they go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.runtime import map_arrow, materialise
from millrace.functions.definitions import text_definition, text_tree, xml_definition, xml_root

_FLAT = "record_id string, node_kind string, parent_key string, child_key string, position int, type string, value string"
#: flat tables of a definition: node kinds and the columns beside record_id, parent_key, child_key and position
TABLES = {"parts": ("step", "entry"), "hops": ("hop",), "params": ("param",), "fields": ("field",), "conditions": ("condition",)}


def child_rows(lists: pa.ListArray, *keys: pa.Array) -> tuple[pa.Array, np.ndarray, list[pa.Array]]:
    """(values, position in the parent from 1 on, the parents' keys taken to the children) of a list array."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parent = pc.list_parent_indices(lists)
    values = pc.list_flatten(lists)
    at = parent.to_numpy(zero_copy_only=False)
    first = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))][:-1]
    return values, np.arange(len(at)) - first[at] + 1, [k.take(parent) for k in keys]


def child_table(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The objects of the array at `path` (`a.b.c` descends through arrays and structs) as a flat table.

    Columns: `keys`, one `pos_<array>` for each array on the way (positions from 1 on, so rows of the tables of one
    path and of a longer one join on keys and positions), then the objects' scalar fields, or `value` for arrays of
    scalars. Null and empty arrays give no row, a null object a row of nulls. A field named like a key or position is
    prefixed by `item_`. Rows stay where they are: there is no shuffle.
    """
    names = path.split(".")
    kind: T.DataType = df.schema
    arrays, roots = [], names[:1]
    for i, x in enumerate(names):
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[x].dataType
        if isinstance(kind, T.ArrayType):
            arrays.append((i, x))
    if not arrays or arrays[-1][0] != len(names) - 1:
        raise ValueError(f"{path} doesn't end at an array")
    item = kind.elementType
    positions = []
    for i, x in arrays:
        p = f"pos_{x}"
        while p in positions or p in keys:
            p = "_" + p
        positions.append(p)
    taken = {*keys, *positions}
    scalars = [f for f in item.fields if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)] if isinstance(item, T.StructType) else []
    out_names = ["item_" + f.name if f.name in taken else f.name for f in scalars] if isinstance(item, T.StructType) else ["value"]
    fields = [df.schema[k] for k in keys] + [T.StructField(p, T.IntegerType()) for p in positions]
    fields += [T.StructField(n, f.dataType) for n, f in zip(out_names, scalars, strict=True)] if isinstance(item, T.StructType) else [T.StructField("value", item)]
    schema = T.StructType(fields)
    where = {i for i, _ in arrays}

    def flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carried = [b.column(k) for k in keys]
            values: pa.Array = b.column(names[0])
            for i, x in enumerate(names):
                if i:
                    values = pc.struct_field(values, x)
                if i in where:
                    values, pos, carried = child_rows(values, *carried)
                    carried.append(pa.array(pos, pa.int32()))
            ks, ps = carried[: len(keys)], carried[len(keys) :]
            own = [pc.struct_field(values, f.name) for f in scalars] if isinstance(item, T.StructType) else [values]
            yield pa.RecordBatch.from_arrays([*ks, *ps, *own], schema.names)

    return map_arrow(df.select(*keys, *roots), flatten, schema)


def _lists(rows: list[list], build) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), build([x for r in rows for x in r]))


def _strings(items: list, get) -> pa.Array:
    return pa.array([get(x) for x in items], pa.string())


def _flat(ids: pa.Array, kind, parent: pa.Array, child: pa.Array, pos: np.ndarray, type_: pa.Array | None, value: pa.Array | None) -> pa.RecordBatch:
    n = len(ids)
    kind = pa.array([kind] * n, pa.string()) if isinstance(kind, str) else kind
    return pa.RecordBatch.from_arrays([ids, kind, parent, child, pa.array(pos, pa.int32()), pa.nulls(n, pa.string()) if type_ is None else type_, pa.nulls(n, pa.string()) if value is None else value], ["record_id", "node_kind", "parent_key", "child_key", "position", "type", "value"])


def _pairs(items: list[tuple[str, str]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([_strings(items, lambda x: x[0]), _strings(items, lambda x: x[1])], ["name", "value"])


def _flatten_definitions(ids: list[str], found: list[dict]) -> Iterator[pa.RecordBatch]:
    rid, names = pa.array(ids, pa.string()), _strings(found, lambda d: d["name"])
    parts = _lists([d["parts"] for d in found], lambda v: pa.StructArray.from_arrays([_strings(v, lambda s: s["kind"]), _strings(v, lambda s: s["name"]), _strings(v, lambda s: s["type"]), _lists([s["fields"] for s in v], _pairs), _lists([s["params"] for s in v], _pairs)], ["kind", "name", "type", "fields", "params"]))
    part, pos, (prid, owner) = child_rows(parts, rid, names)
    step = part.field("name")
    yield _flat(prid, part.field("kind"), owner, step, pos, part.field("type"), None)
    for column, kind in (("fields", "field"), ("params", "param")):
        v, pos, (r, s) = child_rows(part.field(column), prid, step)
        yield _flat(r, kind, s, v.field("name"), pos, v.field("value") if kind == "field" else None, None if kind == "field" else v.field("value"))
    v, pos, (r, s) = child_rows(_lists([d["params"] for d in found], _pairs), rid, names)
    yield _flat(r, "param", s, v.field("name"), pos, None, v.field("value"))
    hops = _lists([d["hops"] for d in found], lambda v: pa.StructArray.from_arrays([_strings(v, lambda h: h[k]) for k in ("from", "to", "enabled")], ["from", "to", "enabled"]))
    v, pos, (r,) = child_rows(hops, rid)
    yield _flat(r, "hop", v.field("from"), v.field("to"), pos, None, v.field("enabled"))
    # conditions: one list array a level, however deep
    level = [s["conditions"] for d in found for s in d["parts"]]
    parent, r, mark = step, prid, "#"
    while any(level):
        inner: list[list] = [c["inner"] for v in level for c in v]
        v, pos, (r, parent) = child_rows(_lists(level, lambda v: pa.StructArray.from_arrays([_strings(v, lambda c: c["left"]), _strings(v, lambda c: c["function"])], ["left", "function"])), r, parent)
        key = pc.binary_join_element_wise(parent, pa.array([str(p) for p in pos], pa.string()), mark)
        yield _flat(r, "condition", parent, key, pos, v.field("function"), v.field("left"))
        level, parent, mark = inner, key, "."


def _definitions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, found = [], []
        for rid, xml, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            root = xml_root(xml)
            d = xml_definition(root) if root is not None else text_definition(text_tree(text)) if text is not None else None
            if d is not None:
                ids.append(rid)
                found.append(d)
        if found:
            yield from _flatten_definitions(ids, found)


def definition_rows(files: DataFrame, texts: DataFrame) -> DataFrame:
    """All parts of all definitions: (record_id, node_kind, parent_key, child_key, position, type, value).

    `files` has id and content (XML bytes), `texts` id and content (YAML or JSON). Content that is null, empty, not well
    formed or no definition gives no row. Positions count from 1 on within the parent. Parts without a name have the
    empty name, hops without an end and fields without a name are left out. Repeated parts are kept; further columns
    are ignored.
    """
    rows = files.select(F.col("id").cast("string").alias("id"), F.col("content").cast("binary").alias("xml"), F.lit(None).cast("string").alias("text"))
    rows = rows.unionByName(texts.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("binary").alias("xml"), F.col("content").cast("string").alias("text")))
    return map_arrow(rows, _definitions, _FLAT)


def definition_tables(files: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """One flat table for each kind of part (see TABLES), linked by record_id and parent_key. The texts are read once, into
    a table that all of them select from."""
    rows = materialise(definition_rows(files, texts))
    return {k: rows.where(F.col("node_kind").isin(*kinds)) for k, kinds in TABLES.items()}


def definition_links(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (record_id, node_kind, parent_key, child_key) of all parts."""
    return definition_rows(files, texts).select("record_id", "node_kind", "parent_key", "child_key").distinct()
