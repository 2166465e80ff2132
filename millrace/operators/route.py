"""Filters and routing: each target is one filter over the same frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.functions.scalar import compare
from millrace.registry import Context, Params, step


@step("FilterRows", router=True, narrow=True)
def filter_rows(ins: list[Frame], p: Params, c: Context) -> dict[str, Frame]:
    """Rows that pass go to trueStep, the others (null fields among them) to falseStep; where both are one step, it gets
    all rows."""
    f = ins[0]
    column = p.text("column", "0")
    try:
        column = f.index(column)
    except ValueError:
        column = 0
    numeric = f.number(column) if f.is_numeric(column) else None
    passes = compare(f.col(column), p.text("operator", "EQ"), p.text("value"), numeric)
    fails = ~F.coalesce(passes, F.lit(False))
    yes, no = p.text("trueStep"), p.text("falseStep")
    if yes and yes == no:
        return {yes: f}
    return {t: f.where(w) for t, w in ((yes, passes), (no, fails)) if t}


@step("SwitchCase", router=True, narrow=True)
def switch_case(ins: list[Frame], p: Params, c: Context) -> dict[str, Frame]:
    f = ins[0]
    s = f.col(p.text("column", "0")).cast("string")
    targets: dict[str, list[str]] = {}
    for value, target in p.keyed("case").items():
        targets.setdefault(target, []).append(value)
    known = [v for vs in targets.values() for v in vs]
    tests = {t: F.coalesce(s.isin(vs), F.lit(False)) for t, vs in targets.items()}
    if default := p.text("defaultStep"):
        rest = s.isNull() | ~s.isin(known) if known else F.lit(True)
        tests[default] = tests[default] | rest if default in tests else rest
    return {t: f.where(w) for t, w in tests.items()}


@step("Abort", narrow=True)
def abort(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Fails when the first row that meets the condition is read; the check is a filter, so that it is never pruned."""
    f = ins[0]
    s = f.col(p.text("column", "0")).cast("string")
    hit = {"NULL": s.isNull(), "NOT_NULL": s.isNotNull(), "EMPTY": F.coalesce(s == "", F.lit(True)), "NOT_EMPTY": F.coalesce(s != "", F.lit(False))}
    condition = hit.get(p.text("abortCondition", "NOT_NULL").upper(), s.isNotNull())
    stop = F.raise_error(F.lit(p.text("message", "aborted by the pipeline"))).cast("boolean")
    return f.where(F.when(condition, stop).otherwise(F.lit(True)))
