"""Projection, constants, scalar functions: one narrow transformation each."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions import scalar
from millrace.functions.formula import compile_formula
from millrace.registry import Context, Params, step


@step("SelectValues", narrow=True)
def select_values(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    at = [f.index(x) for x in p.items_of("columns") or [p.required("columns")]]
    names = p.items_of("names") or [f.names[i] if 0 <= i < f.width else f"f{k}" for k, i in enumerate(at)]
    return f.put([f.col(i) for i in at], names)


@step("Constant", narrow=True)
def constant(ins: list[Frame], p: Params, c: Context) -> Frame:
    values = p.indexed("value")
    return ins[0].append(*[F.lit(v) for v in values], names=_names(ins[0], p, len(values)))


@step("SetValueConstant", narrow=True)
def set_value_constant(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    i = f.index(p.required("column"))
    value = F.lit(p.text("value"))
    return f.set(i, value if f.text else _like(f, i, value))


@step("SetValueField", narrow=True)
def set_value_field(ins: list[Frame], p: Params, c: Context) -> Frame:
    return ins[0].set(ins[0].index(p.required("targetColumn")), ins[0].col(p.required("sourceColumn")))


@step("ConcatFields", narrow=True)
def concat_fields(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Null counts as empty, and its separator stays."""
    f = ins[0]
    parts = [F.coalesce(f.col(x).cast("string"), F.lit("")) for x in p.items_of("columns")]
    return f.append(F.concat_ws(p.text("separator", ""), *parts) if parts else F.lit(""), names=_names(f, p, 1))


@step("FieldSplitter", narrow=True)
def field_splitter(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The parts take the field's place. Without outputCount one pass finds the widest row."""
    f = ins[0]
    i = f.index(p.required("column"))
    parts = F.split(f.col(i).cast("string"), scalar.literal(p.text("separator", ",")), -1)
    n = p.integer("outputCount", -1)
    if n < 0:
        n = f.df.agg(F.max(F.size(parts))).first()[0] or 1
        n = max(n, 1)
    columns, names = f.fields(), list(f.names)
    columns[i : i + 1] = [F.get(parts, F.lit(k)) for k in range(n)]
    names[i : i + 1] = p.items_of("names") or [f"{names[i]}_{k + 1}" for k in range(n)]
    return f.put(columns, names)


@step("CloneRow")
def clone_row(ins: list[Frame], p: Params, c: Context) -> Frame:
    n = p.integer("cloneCount", 1)
    f = ins[0]
    if n <= 0:
        return f.where(F.lit(False))
    df = f.df.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("__n"))
    g = Frame(df, f.names, f.order, f.text)
    return g.with_order([*[(F.col(o.column), o.descending) for o in g.order], (F.col("__n"), False)], ())


@step("Dummy", narrow=True)
def dummy(ins: list[Frame], p: Params, c: Context) -> Frame:
    return ins[0]


@step("SetVariable")
def set_variable(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The variable is the field of the last row; no row leaves it as it is."""
    f, at = ins[0].placed()
    last = f.df.agg(F.max_by(F.struct(f.col(p.required("column")).cast("string").alias("v")), at)["v"]).first()[0]
    if last is not None:
        c.variables[p.required("variableName")] = last
    return f


@step("GetVariable", narrow=True)
def get_variable(ins: list[Frame], p: Params, c: Context) -> Frame:
    name = p.required("variableName")
    value = c.variables.get(name, os.environ.get(name, p.text("defaultValue", "")))
    return ins[0].append(F.lit(value), names=_names(ins[0], p, 1))


@step("StringOperations", narrow=True)
def string_operations(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    i = f.index(p.required("column"))
    return f.set(i, scalar.string_operation(f.col(i).cast("string"), p.text("operation", "trim").lower()))


@step("ReplaceString", narrow=True)
def replace_string(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    i = f.index(p.required("column"))
    s, new = f.col(i).cast("string"), p.text("replacement", "")
    search = p.required("search")
    return f.set(i, F.regexp_replace(s, search, new) if p.flag("regex", False) else F.replace(s, F.lit(search), F.lit(new)))


@step("StringCut", narrow=True)
def string_cut(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    i = f.index(p.required("column"))
    return f.set(i, scalar.substring(f.col(i).cast("string"), p.integer("fromIndex", 0), p.integer("toIndex", -1)))


@step("RegexEval", narrow=True)
def regex_eval(ins: list[Frame], p: Params, c: Context) -> Frame:
    """One field for each group of the first match; null without a match. An unmatched group gives null too, and so does
    a group that matched nothing, which Spark's extraction can't tell apart."""
    import re

    f = ins[0]
    s, pattern = f.col(p.required("column")).cast("string"), p.required("pattern")
    n = len(re.findall(r"(?<!\\)\((?!\?)|(?<!\\)\(\?<[A-Za-z]", re.sub(r"\[(?:\\.|[^\]])*\]", "", pattern)))
    return f.append(*[F.when(s.rlike(pattern), F.nullif(F.regexp_extract(s, pattern, k + 1), F.lit(""))) for k in range(n)], names=_names(f, p, n))


@step("ValueMapper", narrow=True)
def value_mapper(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    i = f.index(p.required("column"))
    s = f.col(i).cast("string")
    pairs = list(zip(p.indexed("from"), p.indexed("to"), strict=False))
    got = F.lit(p.text("defaultValue")) if "defaultValue" in p else s
    for a, b in reversed(pairs):
        got = F.when(s == a, F.lit(b)).otherwise(got)
    return f.set(i, got)


@step("IfNull", narrow=True)
def if_null(ins: list[Frame], p: Params, c: Context) -> Frame:
    f, value = ins[0], p.text("defaultValue", "")
    one = p.text("column", "-1")
    at = range(f.width) if one == "-1" else [f.index(one)]
    return f.put([F.coalesce(x, F.lit(value) if f.text else _like(f, i, F.lit(value))) if i in at else x for i, x in enumerate(f.fields())], f.names)


@step("NullIf", narrow=True)
def null_if(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    i = f.index(p.required("column"))
    return f.set(i, F.when(f.col(i).cast("string").eqNullSafe(F.lit(p.text("value"))), None).otherwise(f.col(i)))


@step("Calculator", narrow=True)
def calculator(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    a = f.number(p.required("colA"))
    b = f.number(p["colB"]) if p.text("colB") else F.lit(p.text("valueB", "0")).try_cast("double")
    return f.append(scalar.shown(scalar.calculate(a, b, p.text("operation", "ADD")), f.text), names=_names(f, p, 1, "fieldName"))


@step("Formula", narrow=True)
def formula(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    names = [x.strip() for x in p.text("fieldNames", "").split(",")] if p.text("fieldNames") else f.names
    return f.append(compile_formula(p.required("formulaString"), names, f.fields()), names=_names(f, p, 1, "fieldName"))


@step("CheckSum", narrow=True)
def check_sum(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    columns = [f.col(x) for x in p.items_of("columns")] or f.fields()
    return f.append(scalar.checksum(columns, p.text("algorithm", "MD5")), names=_names(f, p, 1))


@step("SplitFieldToRows3")
def split_field_to_rows(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A row for each token, empty ones too; a null field leaves its row as it is."""
    f = ins[0]
    i = f.index(p.text("column", "0"))
    tokens = F.split(f.col(i).cast("string"), scalar.literal(p.text("separator", ",")), -1)
    df = f.df.select(*[x for k, x in enumerate(f.fields()) if k != i], *f.keep(), F.posexplode_outer(tokens).alias("__n", f"c{i}"))
    g = Frame(df, f.names, f.order, f.text)
    return g.with_order([*[(F.col(o.column), o.descending) for o in g.order], (F.col("__n"), False)], ())


@step("Validator", narrow=True)
def validator(ins: list[Frame], p: Params, c: Context) -> Frame:
    f = ins[0]
    s = f.col(p.text("column", "0")).cast("string")
    good = F.lit(True)
    if p.text("pattern"):
        good = good & s.rlike(rf"\A(?:{p['pattern']})\z")
    if p.text("minLength"):
        good = good & (F.length(s) >= p.integer("minLength", 0))
    if p.text("maxLength"):
        good = good & (F.length(s) <= p.integer("maxLength", 0))
    return f.append(F.when(s.isNull(), F.lit(p.flag("allowNull", False))).otherwise(good).cast("string"), names=_names(f, p, 1))


@step("NumberRange", narrow=True)
def number_range(ins: list[Frame], p: Params, c: Context) -> Frame:
    """The label of the first range that holds the number, both ends included."""
    f = ins[0]
    n, got = f.number(p.required("column")), F.lit(p.text("defaultLabel", ""))
    for low, high, label in reversed(list(zip(p.indexed("lowerBound"), p.indexed("upperBound"), p.indexed("label"), strict=False))):
        got = F.when(n.between(F.lit(float(low)), F.lit(float(high))), F.lit(label)).otherwise(got)
    return f.append(got, names=_names(f, p, 1))


def _names(f: Frame, p: Params, n: int, single: str = "name") -> list[str]:
    own = p.items_of("names") or p.items_of(single)
    return own if len(own) == n else [f"f{f.width + k}" for k in range(n)]


def _like(f: Frame, i: int, value):
    return value.try_cast(f.df.schema[f"c{i}"].dataType)
