"""A transformation as one DataFrame plan for each sink.

Steps are built in topological order; a step that several others read is persisted until the run ends, sinks and steps
with effects act when they are reached, everything else stays lazy.
"""

from __future__ import annotations

import os
from dataclasses import replace

import millrace.operators.effects  # noqa: F401
import millrace.operators.joins  # noqa: F401
import millrace.operators.ordering  # noqa: F401
import millrace.operators.project  # noqa: F401
import millrace.operators.route  # noqa: F401
import millrace.operators.scripting  # noqa: F401
import millrace.sources.excel  # noqa: F401
import millrace.sources.files  # noqa: F401
import millrace.sources.jdbc  # noqa: F401
from millrace.frame import Frame
from millrace.plans.model import TransformationDefinition, load_transformation
from millrace.registry import EFFECTS, ROUTERS, SOURCES, STEPS, Context, Params


def topological(ids: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Kahn's order, by definition order among equals; cycles are an error."""
    waiting = {i: sum(1 for _, t in edges if t == i) for i in ids}
    ready, out = [i for i in ids if not waiting[i]], []
    while ready:
        i = ready.pop(0)
        out.append(i)
        for f, t in edges:
            if f == i:
                waiting[t] -= 1
                if not waiting[t]:
                    ready.append(t)
        ready.sort(key=ids.index)
    if len(out) < len(ids):
        raise ValueError(f"the steps {sorted(set(ids) - set(out))} form a cycle")
    return out


def build(definition: TransformationDefinition, c: Context) -> dict[str, Frame | dict[str, Frame]]:
    """Run all effects and return each step's output."""
    c.variables = {**os.environ, **definition.parameters, **c.variables}
    steps = {s.id: s for s in definition.steps}
    hops = [h for h in definition.hops if h.enabled]
    for h in hops:
        if h.from_ not in steps or h.to not in steps:
            raise ValueError(f"the hop {h.from_} -> {h.to} leads to an unknown step")
    edges = [(h.from_, h.to) for h in hops]
    if len(set(edges)) < len(edges):
        raise ValueError("two hops join the same steps")
    done: dict[str, Frame | dict[str, Frame]] = {}
    kept = []
    try:
        for i in topological(list(steps), edges):
            s = steps[i]
            if s.type not in STEPS:
                raise ValueError(f"unknown step type {s.type}")
            p = Params(s.params).resolved(c.variables)
            ins = []
            for f, t in edges:
                if t == i:
                    got = done[f]
                    if isinstance(got, dict):
                        some = next(iter(got.values()), None)
                        got = got.get(i) or (some.where(_never()) if some is not None else None)
                    if got is not None:
                        ins.append(got)
            if not ins and s.type not in SOURCES:
                raise ValueError(f"step {i} has no input")
            readers = sum(1 for f, _ in edges if f == i)
            if s.type in ROUTERS and readers > 1:
                ins[0] = _kept(ins[0], kept)
            if s.type in EFFECTS and readers:
                ins = [_kept(f, kept) for f in ins]
            out = STEPS[s.type](ins, p, c)
            if s.type not in ROUTERS and readers > 1:
                out = _kept(out, kept)
            done[i] = out
            if not readers and s.type not in EFFECTS and s.type not in ("MappingOutput", "RowsToResult") and c.mapping_input is None and isinstance(out, Frame):
                out.df.write.format("noop").mode("overwrite").save()  # a last step is drained
    finally:
        for df in kept:
            if not c.results.get("mapping") and not c.results.get("rows"):
                df.unpersist()
    return done


def _never():
    from pyspark.sql import functions as F

    return F.lit(False)


def _kept(f: Frame, kept: list) -> Frame:
    if f.df.storageLevel.useMemory or f.df.storageLevel.useDisk:
        return f
    df = f.df.persist()
    kept.append(df)
    return replace(f, df=df)


def run_transformation(spark, definition: TransformationDefinition | str | dict, variables: dict[str, str] | None = None, **options) -> Context:
    """Run a definition (or its path or text); the context holds variables and handed over rows."""
    if not isinstance(definition, TransformationDefinition):
        definition = load_transformation(definition)
    c = Context(spark, dict(variables or {}), **options)
    build(definition, c)
    return c
