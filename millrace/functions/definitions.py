"""Reading pipeline definitions (XML, YAML, JSON) into plain nested values; None where a text is not well formed."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import yaml

_LOADER = getattr(yaml, "CBaseLoader", yaml.BaseLoader)
_DECLARED = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"'][^>]*\?>")


def xml_root(content: bytes | str | None) -> ET.Element | None:
    """The root element, decoded as the document declares; entities of its own are not expanded beyond expat's limits."""
    if not content:
        return None
    data = content.encode("utf-8") if isinstance(content, str) else bytes(content)
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return None
    except (ValueError, LookupError):  # an encoding of several bytes a character, which expat leaves to us
        m = _DECLARED.match(data)
        try:
            return ET.fromstring(data[m.end() :].decode(m[1].decode())) if m else None
        except (ET.ParseError, UnicodeError, LookupError, ValueError):
            return None


def text_of(e: ET.Element | None) -> str | None:
    return None if e is None else "".join(e.itertext()).strip()


def _children(e: ET.Element | None, wrapper: str, item: str) -> list[ET.Element]:
    """`item` elements right below e, or below its `wrapper` elements, in document order."""
    out: list[ET.Element] = []
    for x in e if e is not None else ():
        if x.tag == item:
            out.append(x)
        elif x.tag == wrapper:
            out += [y for y in x if y.tag == item]
    return out


def _xml_fields(step: ET.Element) -> list[tuple[str, str]]:
    out = []
    for x in step:
        if x.tag == "fields":
            for f in x:
                if f.tag == "field":
                    name = text_of(f.find("name")) if f.find("name") is not None else (f.get("name") or "").strip()
                    kind = text_of(f.find("type")) if f.find("type") is not None else (f.get("type") or "").strip()
                    out.append((name or "", kind or ""))
        elif x.tag == "fieldNames":
            names = [n.strip() for n in (text_of(x) or "").split(",")]
            kinds = [k.strip() for k in (text_of(step.find("fieldTypes")) or "").split(",")]
            out += [(n, kinds[i] if i < len(kinds) else "") for i, n in enumerate(names)]
    return [(n, k) for n, k in out if n]


def _xml_condition(c: ET.Element) -> dict:
    """The condition with its inner conditions, read by a stack, so that they may nest to any depth."""
    out: dict = {}
    todo = [(c, out)]
    while todo:
        x, d = todo.pop()
        inner = _children(x, "conditions", "condition")
        d |= {"left": text_of(x.find("leftvalue")), "function": text_of(x.find("function")) or text_of(x.find("operator")), "value": text_of(x.find("value/text")), "inner": [{} for _ in inner]}
        todo += zip(inner, d["inner"], strict=True)
    return out


def xml_definition(root: ET.Element) -> dict | None:
    """{name, parts, hops, params} of a transformation or job."""
    if root.tag not in ("transformation", "job"):
        return None
    kind = "step" if root.tag == "transformation" else "entry"
    info = root.find("info")
    name = text_of(root.find("name")) if root.find("name") is not None else text_of(info.find("name") if info is not None else None)
    parts = []
    for s in _children(root, "steps" if kind == "step" else "entries", kind):
        conditions = [_xml_condition(c) for k in s if k.tag == "compare" for c in _children(k, "conditions", "condition")]
        parts.append({"kind": kind, "name": text_of(s.find("name")) or "", "type": text_of(s.find("type")), "fields": _xml_fields(s), "params": [], "conditions": conditions})
    hops = [h for w in root if w.tag in ("order", "hops") for h in w if h.tag == "hop"]
    hops = [{k: text_of(h.find(k)) for k in ("from", "to", "enabled")} for h in hops]
    hops = [h for h in hops if h["from"] is not None and h["to"] is not None]
    declared = [p for base in (root, info) if base is not None for p in _children(base, "parameters", "parameter")]
    params = [(text_of(p.find("name")) if p.find("name") is not None else (p.get("name") or "").strip(), text_of(p.find("default_value"))) for p in declared]
    return {"name": name or "", "parts": parts, "hops": hops, "params": [(n, v) for n, v in params if n]}


def _scalar(v: object) -> str:
    return "" if v is None else v.strip() if isinstance(v, str) else json.dumps(v) if isinstance(v, dict | list) else str(v)


def _named(v: object) -> list[tuple[str, str]]:
    """Names and values of a mapping, or of a list of {name, ...} or plain names."""
    if isinstance(v, dict):
        return [(_scalar(k), _scalar(x)) for k, x in v.items() if _scalar(k)]
    out = []
    for x in v if isinstance(v, list) else ():
        name = _scalar(x.get("name", "")) if isinstance(x, dict) else _scalar(x)
        if name:
            out.append((name, _scalar(x.get("default", "")) if isinstance(x, dict) else ""))
    return out


def text_tree(content: str | None) -> object:
    """The tree of a YAML or JSON text with all scalars as strings, or None."""
    if not content or not content.strip():
        return None
    if content.lstrip()[:1] in "{[":
        try:
            return json.loads(content)
        except ValueError:
            pass
    try:
        return yaml.load(content, _LOADER)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


def text_definition(tree: object) -> dict | None:
    if not isinstance(tree, dict):
        return None
    parts = []
    for key, kind in (("steps", "step"), ("entries", "entry")):
        for s in tree.get(key) if isinstance(tree.get(key), list) else ():
            if isinstance(s, dict):
                parts.append({"kind": kind, "name": _scalar(s.get("id", s.get("name"))), "type": _scalar(s.get("type")), "fields": [], "params": _named(s.get("params")), "conditions": []})
    hops = [{"from": _scalar(h["from"]), "to": _scalar(h["to"]), "enabled": _scalar(h.get("enabled", ""))} for h in (tree.get("hops") if isinstance(tree.get("hops"), list) else ()) if isinstance(h, dict) and h.get("from") is not None and h.get("to") is not None]
    return {"name": _scalar(tree.get("name")), "parts": parts, "hops": hops, "params": _named(tree.get("parameters"))}
