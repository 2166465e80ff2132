"""Definitions of transformations and jobs, as YAML or JSON."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import yaml


@dataclass
class StepDefinition:
    id: str
    type: str
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class Hop:
    from_: str
    to: str
    enabled: bool = True
    evaluation: str | None = None


@dataclass
class TransformationDefinition:
    name: str
    parameters: dict[str, str] = field(default_factory=dict)
    steps: list[StepDefinition] = field(default_factory=list)
    hops: list[Hop] = field(default_factory=list)


@dataclass
class JobDefinition:
    name: str
    parameters: dict[str, str] = field(default_factory=dict)
    entries: list[StepDefinition] = field(default_factory=list)
    hops: list[Hop] = field(default_factory=list)


def _tree(source: str) -> dict:
    """`source` is a path, or the text itself where it has several lines or braces."""
    if "\n" in source or source.lstrip().startswith("{"):
        return yaml.load(source, yaml.BaseLoader) or {}
    with open(source, encoding="utf-8") as f:
        return yaml.load(f, yaml.BaseLoader) or {}


def _text(v: object) -> str:
    return v if isinstance(v, str) else "" if v is None else yaml.safe_dump(v)


def _parts(items: list | None) -> list[StepDefinition]:
    return [StepDefinition(x["id"], x["type"], {k: _text(v) for k, v in (x.get("params") or {}).items()} if isinstance(x.get("params"), dict) else {}) for x in items or []]


def _hops(items: list | None) -> list[Hop]:
    return [Hop(h["from"], h["to"], str(h.get("enabled", "true")).lower() != "false", h.get("evaluation")) for h in items or []]


def _parameters(d: dict) -> dict[str, str]:
    v = d.get("parameters")
    return {k: _text(x) for k, x in v.items()} if isinstance(v, dict) else {}


def load_transformation(source: str | dict) -> TransformationDefinition:
    d = source if isinstance(source, dict) else _tree(source)
    return TransformationDefinition(_text(d.get("name")), _parameters(d), _parts(d.get("steps")), _hops(d.get("hops")))


def load_job(source: str | dict) -> JobDefinition:
    d = source if isinstance(source, dict) else _tree(source)
    return JobDefinition(_text(d.get("name")), _parameters(d), _parts(d.get("entries")), _hops(d.get("hops")))


def dump(d: TransformationDefinition | JobDefinition) -> str:
    tree = asdict(d)
    job = isinstance(d, JobDefinition)
    tree["hops"] = [{"from": h.from_, "to": h.to} | ({"evaluation": h.evaluation or "unconditional"} if job else {"enabled": h.enabled}) for h in d.hops]
    return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True)
