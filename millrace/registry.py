"""Named step and job entry types, and how their text parameters are read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

from pyspark.sql import SparkSession

STEPS: dict[str, Callable] = {}
ENTRIES: dict[str, Callable] = {}
#: steps that read no input, and steps that return a frame for each target
SOURCES: set[str] = set()
ROUTERS: set[str] = set()
#: steps that act when they are reached, once
EFFECTS: set[str] = set()


def step(*names: str, source: bool = False, router: bool = False, effect: bool = False, narrow: bool = False):
    """Register `f(inputs: list[Frame], params: Params, context: Context) -> Frame | dict[str, Frame]`.

    A `narrow` step keeps each row's place, or drops rows: it takes frames whose order is still that of the scan. All
    others get frames with order columns."""

    def add(f: Callable) -> Callable:
        for n in names:
            STEPS[n] = f if narrow else wraps(f)(lambda ins, p, c: f([x.ordered() for x in ins], p, c))
            for on, group in ((source, SOURCES), (router, ROUTERS), (effect, EFFECTS)):
                if on:
                    group.add(n)
        return f

    return add


def entry(*names: str):
    """Register `f(params: Params, context: JobContext) -> bool`."""

    def add(f: Callable) -> Callable:
        for n in names:
            ENTRIES[n] = f
        return f

    return add


@dataclass
class Context:
    """What a run shares: variables, folders, permissions, rows handed over, and pluggable connections."""

    spark: SparkSession
    variables: dict[str, str] = field(default_factory=dict)
    base_path: str = ""
    allow_exec: bool = False
    results: dict[str, Any] = field(default_factory=dict)
    mapping_input: Any = None
    fetch: Callable | None = None
    log: Callable[[str], None] = print
    load: Callable | None = None


class Params(dict):
    def text(self, name: str, default: str | None = None) -> str | None:
        v = self.get(name)
        return default if v is None else str(v)

    def required(self, name: str) -> str:
        v = self.text(name)
        if v is None or v == "":
            raise ValueError(f"parameter {name} is missing")
        return v

    def integer(self, name: str, default: int) -> int:
        v = self.text(name)
        return default if v is None or not v.strip() else int(v)

    def flag(self, name: str, default: bool) -> bool:
        v = self.text(name)
        return default if v is None or not v.strip() else v.strip().lower() in ("true", "y", "yes", "1")

    def items_of(self, name: str) -> list[str]:
        v = self.text(name)
        return [x.strip() for x in v.split(",") if x.strip()] if v else []

    def indexed(self, prefix: str) -> list[str]:
        """prefix.0, prefix.1, ... up to the first gap."""
        out = []
        while (v := self.text(f"{prefix}.{len(out)}")) is not None:
            out.append(v)
        return out

    def keyed(self, prefix: str) -> dict[str, str]:
        return {k[len(prefix) + 1 :]: str(v) for k, v in self.items() if k.startswith(prefix + ".")}

    def resolved(self, variables: dict[str, str]) -> Params:
        """`${NAME}` replaced; unknown names stay."""
        put = lambda v: re.sub(r"\$\{([^}]+)\}", lambda m: variables.get(m[1], m[0]), v) if isinstance(v, str) else v
        return Params({k: put(v) for k, v in self.items()})
