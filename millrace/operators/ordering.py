"""Sorting, appending, and steps that depend on the rows' order.

A sort only names the order; sinks and positional steps carry it out, by ranges. Positions, neighbours and running
counts are made block by block (see frame), never in one task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.frame import POS, Frame, Order, concat_orders, running_sum
from millrace.functions import scalar
from millrace.registry import Context, Params, step


@step("SortRows")
def sort_rows(ins: list[Frame], p: Params, c: Context) -> Frame:
    """By the fields as texts (typed frames: by their values): ascending with nulls last, descending with nulls first;
    ties stay as they were."""
    f = ins[0]
    at = [f.index(x) for x in p.items_of("columns")]
    if any(not 0 <= i < f.width for i in at):
        raise ValueError("a sort column is out of range")
    up = p.items_of("ascending")
    return f.with_order([(f.col(i), len(up) > k and up[k].lower() == "false") for k, i in enumerate(at)], sources=at)


@step("SortedMerge")
def sorted_merge(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The merge of sorted inputs; right for unsorted ones as well."""
    return sort_rows([concat_orders(ins)], p, c)


@step("Append")
def append(ins: list[Frame], p: Params, c: Context) -> Frame:
    return concat_orders(ins)


@step("BlockingStep", narrow=True)
def blocking(ins: list[Frame], p: Params, c: Context) -> Frame:
    return ins[0]


@step("Sequence", narrow=True)
def sequence(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0].positioned()
    n = F.lit(p.integer("start", 1)) + F.lit(p.integer("increment", 1)) * F.col(POS)
    return f.append(scalar.shown(n, f.text), names=p.items_of("name") or None)


@step("DetectLastRow")
def detect_last_row(ins: list[Frame], p: Params, c: Context) -> Frame:
    """`true` in the last row, found by its place; only if several rows share that are the rows numbered."""
    f, at = ins[0].placed()
    if any(f.df.schema[k].dataType.typeName() == "struct" for k in f.keep()):
        f = f.positioned()
        at = f.place()
    last = f.df.agg(F.max_by(F.struct(*[F.col(k) for k in f.keep()]), at).alias("v")).first()["v"]
    same = F.lit(True)
    for k, v in zip(f.keep(), last or (), strict=False):
        same = same & F.col(k).eqNullSafe(F.lit(v))
    if last is not None and f.df.where(same).limit(2).count() > 1:
        f = f.positioned()
        same = F.col(POS) == (f.total or 0) - 1
    return f.append(same.cast("string"), names=p.items_of("name") or None)


def _changed(f: Frame, fields: list[int]) -> Frame:
    """A positioned frame with `__new`: 1 where these fields differ from the row before, and in the first row."""
    g = f.with_previous([f.col(i) for i in fields])
    same = F.lit(True)
    for k, i in enumerate(fields):
        same = same & F.col("__prev")[f"v{k}"].eqNullSafe(F.col(f"c{i}"))
    new = F.when(F.col("__prev").isNull() | ~same, 1).otherwise(0)
    return Frame(g.df.withColumn("__new", new).drop("__prev"), g.names, g.order, g.text, g.total)


@step("FieldsChangeSequence", narrow=True)
def fields_change_sequence(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A counter that rises whenever the fields change; it isn't reset."""
    f = ins[0]
    g = _changed(f, [f.index(x) for x in p.items_of("columns")])
    df = running_sum(g, "__new", "__run")
    g = Frame(df, g.names, g.order, g.text, g.total)
    n = F.lit(p.integer("start", 1) - 1) + F.col("__run")
    return g.append(scalar.shown(n, f.text), names=p.items_of("name") or None)


@step("Unique", narrow=True)
def unique(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Drops rows that repeat the row before in these fields (none named: in all)."""
    f = ins[0]
    g = _changed(f, [f.index(x) for x in p.items_of("columns")] or list(range(f.width)))
    kept = Frame(g.df.where("__new = 1"), g.names, g.order, g.text)
    return kept.put(kept.fields(), kept.names)


@step("UniqueRowsByHashSet")
def unique_rows(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The first row of each combination of these fields (none named: of all)."""
    f = ins[0]
    at = [f.index(x) for x in p.items_of("columns")] or list(range(f.width))
    g, key = f.placed()
    rest = [i for i in range(f.width) if i not in at]
    first = F.min_by(F.struct(*[F.col(f"c{i}") for i in rest], F.lit(0).alias("__x")), key).alias("__r")
    df = g.df.groupBy(*[f"c{i}" for i in dict.fromkeys(at)]).agg(first, F.min(key).alias("__o0"))
    return Frame(df, f.names, (Order("__o0"),), f.text).put([F.col("__r")[f"c{i}"] if i in rest else F.col(f"c{i}") for i in range(f.width)], f.names)


def _aggregates(f: Frame, p: Params, unknown, at) -> tuple[list[int], list, list[str]]:
    groups = [f.index(x) for x in p.items_of("groupColumns")]
    columns = [f.index(x) for x in p.items_of("aggColumns")]
    functions = p.items_of("aggFunctions")
    out = [scalar.aggregate(f.col(i), f.number(i), functions[k] if k < len(functions) else "COUNT", at, unknown) for k, i in enumerate(columns)]
    names = p.items_of("aggNames")
    names = names if len(names) == len(out) else [f"{(functions[k] if k < len(functions) else 'COUNT').lower()}_{f.names[i]}" for k, i in enumerate(columns)]
    return groups, [scalar.shown(a, f.text) for a in out], names


@step("GroupBy", narrow=True)
def group_by(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A row for each run of equal keys, in order. An unknown function counts; an empty input gives no row.

    After a sort by the same fields each run is a group: it is aggregated as such, without numbering the rows."""
    f = ins[0]
    at = [f.index(x) for x in p.items_of("groupColumns")]
    sort = f.order[: len(at)]
    if at and {o.source for o in sort} == set(at) and not {"FIRST", "LAST"} & {x.upper() for x in p.items_of("aggFunctions")}:
        groups, aggs, names = _aggregates(f, p, F.count(F.lit(1)), F.lit(0))
        df = f.df.groupBy(*[F.col(f"c{i}").alias(f"__g{k}") for k, i in enumerate(groups)]).agg(*[a.alias(f"__a{k}") for k, a in enumerate(aggs)] or [F.count(F.lit(1)).alias("__n")])
        df = df.select("*", *[F.col(f"__g{groups.index(o.source)}").alias(f"__o{k}") for k, o in enumerate(sort)])
        return _grouped(df, f, groups, names, tuple(Order(f"__o{k}", o.descending) for k, o in enumerate(sort)))
    g = _changed(f, [f.index(x) for x in p.items_of("groupColumns")])
    g = Frame(running_sum(g, "__new", "__run"), g.names, g.order, g.text, g.total)
    groups, aggs, names = _aggregates(g, p, F.count(F.lit(1)), F.col(POS))
    keys = [F.col(f"c{i}").alias(f"__g{k}") for k, i in enumerate(groups)]
    df = g.df.groupBy("__run", *keys).agg(F.min(POS).alias("__o0"), *[a.alias(f"__a{k}") for k, a in enumerate(aggs)])
    return _grouped(df, f, groups, names)


@step("MemoryGroupBy")
def memory_group_by(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A row for each combination of keys, by first appearance. An unknown function gives null; null keys are a group."""
    f, at = ins[0].placed()
    groups, aggs, names = _aggregates(f, p, F.lit(None).cast("string"), at)
    keys = [F.col(f"c{i}").alias(f"__g{k}") for k, i in enumerate(groups)]
    df = f.df.groupBy(*keys).agg(F.min(at).alias("__o0"), *[a.alias(f"__a{k}") for k, a in enumerate(aggs)], F.count(F.lit(1)).alias("__n"))
    return _grouped(df.where("__n > 0"), f, groups, names)


def _grouped(df, f: Frame, groups: list[int], names: list[str], order: tuple[Order, ...] = (Order("__o0"),)) -> Frame:
    columns = [F.col(f"__g{k}") for k in range(len(groups))] + [F.col(f"__a{k}") for k in range(len(names))]
    return Frame(df, (), order, f.text).put(columns, [*[f.names[i] for i in groups], *names])


@step("Denormaliser")
def denormaliser(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A field for each pivot value; the last value of a key wins, absent ones are null, other pivot values count not."""
    f, at = ins[0].placed()
    keys = [f.index(x) for x in p.items_of("keyColumns")]
    pivot, value = f.col(p.required("pivotColumn")).cast("string"), f.col(p.required("valueColumn"))
    values = p.items_of("pivotValues")
    picks = [F.max_by(F.struct(value.alias("v")), F.when(pivot == v, at))["v"] for v in values]
    df = f.df.groupBy(*[F.col(f"c{i}").alias(f"__g{k}") for k, i in enumerate(keys)]).agg(F.min(at).alias("__o0"), F.count(F.lit(1)).alias("__n"), *[F.when(F.count_if(pivot == v) > 0, x).alias(f"__a{k}") for k, (v, x) in enumerate(zip(values, picks, strict=True))])
    columns = [F.col(f"__g{k}") for k in range(len(keys))] + [F.col(f"__a{k}") for k in range(len(values))]
    return Frame(df.where("__n > 0"), (), (Order("__o0"),), f.text).put(columns, [*[f.names[i] for i in keys], *values])


@step("Normaliser")
def normaliser(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A row for each value field, nulls included: keys, the field's label, its value."""
    f = ins[0]
    keys = [f.index(x) for x in p.items_of("keyColumns")]
    values = [f.index(x) for x in p.items_of("valueColumns")]
    labels = p.items_of("valueNames")
    labels = [labels[k] if k < len(labels) else f.names[i] for k, i in enumerate(values)]
    kinds = {f.df.schema[f"c{i}"].dataType.simpleString() for i in values}
    cast = (lambda x: x) if len(kinds) == 1 else (lambda x: x.cast("string"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), cast(f.col(i)).alias("v")) for k, (n, i) in enumerate(zip(labels, values, strict=True))])).alias("__e")
    g = Frame(f.df.select("*", each), f.names, f.order, f.text)
    g = Frame(g.df.select("*", F.col("__e.k").alias("__ek")), g.names, g.order, g.text)
    columns = [f.col(i) for i in keys] + [F.col("__e.n"), F.col("__e.v")]
    order = [*[(F.col(o.column), o.descending) for o in f.order], (F.col("__ek"), False)]
    df = g.df.select(*[x.alias(f"c{k}") for k, x in enumerate(columns)], *[x.alias(f"__o{k}") for k, (x, _) in enumerate(order)])
    return Frame(df, (*[f.names[i] for i in keys], *(p.items_of("names") or ["name", "value"])), tuple(Order(f"__o{k}", d) for k, (_, d) in enumerate(order)), f.text)
