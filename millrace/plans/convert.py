"""XML pipeline definitions to the YAML model: transformations, jobs, and zipped projects of both.

Field names are resolved to positions along the hops where the fields are known; other names stay, and are looked up
among the frame's names when the pipeline runs.
"""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile

from millrace.plans.compiler import topological
from millrace.plans.model import Hop, JobDefinition, StepDefinition, TransformationDefinition, dump

#: names of step types that differ from the registry's (fixed values)
STEP_NAMES = {"CSVInput": "CsvInput", "Dummy (do nothing)": "Dummy", "ModifiedJavaScriptValue": "ScriptValueMod", "UniqueRows": "Unique", "AppendStreams": "Append", "MergeRows (diff)": "MergeRows", "Mapping (Sub-transformation)": "Mapping"}
#: names of job entry types (fixed values)
ENTRY_NAMES = {
    "TRANS": "RunTransformation", "TRANSFORMATION": "RunTransformation", "JOB": "RunJob", "MAIL": "Mail", "WRITE_TO_LOG": "WriteToLog", "EXEC_SQL": "ExecSQL",
    "SET_VARIABLE": "SetVariable", "GET_VARIABLE": "GetVariable", "EXEC_PROCESS": "ExecProcess", "SHELL": "ExecProcess", "FILE_EXISTS": "FileExists", "CHECK_FILE_EXISTS": "FileExists",
    "BLOCKUNTILSTEPSFINISH": "Dummy", "DUMMY": "Dummy", "EVAL_FILES_METRICS": "Dummy", "DELETE_FILE": "Dummy", "EVAL": "Dummy", "MOVE_FILES": "Dummy", "SUCCESS": "Success", "ABORT": "Abort", "START": "Start",
}
#: database types (fixed values)
DATABASES = {"ORACLE": "oracle", "MYSQL": "mysql", "POSTGRESQL": "postgresql", "MSSQLNATIVE": "sqlserver", "MSSQL": "sqlserver", "H2": "h2", "DB2": "db2"}
#: spellings of comparisons and calculations (fixed values)
OPERATORS = {">": "GT", "<": "LT", ">=": "GTE", "=>": "GTE", "GREATER_EQUAL": "GTE", "<=": "LTE", "=<": "LTE", "LESS_EQUAL": "LTE", "=": "EQ", "EQUAL": "EQ", "<>": "NEQ", "!=": "NEQ", "NOT_EQUAL": "NEQ"}
CALCULATIONS = {"PRODUCT": "MULTIPLY", "DIVIDE_INT": "DIVIDE", "PLUS": "ADD", "MINUS": "SUBTRACT", "REMAINDER": "MODULO"}
_SOURCES = {"CsvInput", "TextFileInput", "ExcelInput", "RowGenerator", "PropertyInput", "GetFileNames", "SystemInfo"}


def _parsed(xml: str | bytes) -> ET.Element:
    if b"<!DOCTYPE" in (xml.encode() if isinstance(xml, str) else xml):
        raise ValueError("a document type declaration isn't accepted")
    return ET.fromstring(xml)


def _t(e: ET.Element | None, *paths: str) -> str | None:
    """The first text among the paths that isn't blank."""
    for p in paths:
        x = e.find(p) if e is not None else None
        if x is not None and (s := "".join(x.itertext()).strip()):
            return s
    return None


def _yes(v: str | None, default: str = "Y") -> str:
    return "true" if (v or default).strip().lower() in ("y", "yes", "true") else "false"


def _given(**params: str | None) -> dict[str, str]:
    return {k: v for k, v in params.items() if v is not None and v.strip()}


def _all(e: ET.Element | None, path: str, *names: str) -> list[str]:
    return [s for x in (e.findall(path) if e is not None else ()) if (s := _t(x, *names))]


def _fields(e: ET.Element) -> list[tuple[str, str]]:
    out = [(n, _t(f, "type") or f.get("type") or "String") for f in e.findall("fields/field") if (n := _t(f, "name") or (f.get("name") or "").strip())]
    if not out and (names := _t(e, "fieldNames")):
        kinds = (_t(e, "fieldTypes") or "").split(",")
        out = [(n.strip(), kinds[i].strip() if i < len(kinds) and kinds[i].strip() else "String") for i, n in enumerate(names.split(",")) if n.strip()]
    return out


def _text_input(e: ET.Element) -> dict[str, str]:
    f = _fields(e)
    return _given(filePath=_t(e, "file/name", "filename"), separator=_t(e, "separator") or ",", enclosure=_t(e, "enclosure") or '"', hasHeader=_yes(_t(e, "header", "file/header")), sheetName=_t(e, "sheetname", "sheets/sheet/name"), fieldNames=",".join(n for n, _ in f), fieldTypes=",".join(k for _, k in f))


def _text_output(e: ET.Element) -> dict[str, str]:
    names = ",".join(_all(e, "fields/field", "name"))
    return _given(filePath=_t(e, "file/name", "filename"), separator=_t(e, "file/separator", "separator") or ",", writeHeader=_yes(_t(e, "file/header", "header")), outputCols=names, fieldNames=names)


def _filter(e: ET.Element) -> dict[str, str]:
    compare = e.find("compare")
    first = next((c for c in (compare if compare is not None else e).iter("condition") if c.find("leftvalue") is not None), None)
    out = _given(trueStep=_t(e, "send_true_to", "true_step"), falseStep=_t(e, "send_false_to", "false_step"))
    if first is not None:
        op = _t(first, "function")
        return out | _given(column=_t(first, "leftvalue"), operator=OPERATORS.get(op, op) if op else None, value=_t(first, "rightvalue", "rightstring", "value/text"))
    op = _t(compare, "operator")
    return out | _given(column=_t(compare, "fieldname"), operator=OPERATORS.get(op, op) if op else None, value=_t(compare, "value"))


def _switch(e: ET.Element) -> dict[str, str]:
    out = _given(column=_t(e, "fieldname", "field_name"), defaultStep=_t(e, "default_target_step", "default_step"))
    for c in e.iter("case"):
        value, target = _t(c, "value"), _t(c, "target_step", "target")
        if value is not None and target:
            out[f"case.{value}"] = target
    return out


def _calculator(e: ET.Element) -> dict[str, str]:
    c = next(e.iter("calculation"), None)
    kind = (_t(c, "calc_type", "conversion") or "").upper()
    b = _t(c, "field_b")
    return _given(fieldName=_t(c, "field_name", "newfieldname"), colA=_t(c, "field_a", "fieldname"), colB=b, valueB=None if b else _t(c, "value"), operation=CALCULATIONS.get(kind, kind))


def _group(e: ET.Element) -> dict[str, str]:
    aggs = [(_t(f, "subject"), _t(f, "type"), _t(f, "aggregate", "name")) for f in [*e.findall("fields/field"), *e.findall("aggregates/aggregate")]]
    groups = _all(e, "group/field", "name")
    aggs = [(s or (groups[0] if groups else "0"), (k or "COUNT").upper(), n or f"{(k or 'COUNT').lower()}_{s}") for s, k, n in aggs if s or k]
    return _given(groupColumns=",".join(groups), aggColumns=",".join(s for s, _, _ in aggs), aggFunctions=",".join(k for _, k, _ in aggs), aggNames=",".join(n for _, _, n in aggs))


def _sort(e: ET.Element) -> dict[str, str]:
    rows = [(n, (_t(f, "ascending") or "Y").upper() != "N" and (_t(f, "sort_direction") or "").lower() != "descending") for f in e.findall("fields/field") if (n := _t(f, "name"))]
    return _given(columns=",".join(n for n, _ in rows), ascending=",".join("true" if up else "false" for _, up in rows), chunkSizeMb=_t(e, "sort_size"))


def _keys(e: ET.Element, *containers: str) -> str | None:
    for c in containers:
        if (x := e.find(c)) is not None:
            names = [(_t(k, "name") or "".join(k.itertext()).strip()).rpartition(".")[2].strip() for k in x.findall("key")]
            return ",".join(n for n in names if n)
    return None


def _merge_join(e: ET.Element) -> dict[str, str]:
    return _given(joinType=_t(e, "join_type") or "INNER", step1=_t(e, "step1"), step2=_t(e, "step2"), leftColumns=_keys(e, "keys_1", "key_fields1"), rightColumns=_keys(e, "keys_2", "key_fields2"))


def _lookup(e: ET.Element) -> dict[str, str]:
    look = e.find("lookup")
    if look is not None:
        keys = [(_t(k, "name"), _t(k, "field")) for k in look.findall("key")]
        values = [(n, _t(v, "rename") or n) for v in look.findall("value") if (n := _t(v, "name"))]
    else:
        keys = [(_t(e, "keystream"), _t(e, "keylookup"))]
        values = [(n, _t(v, "valuename") or n) for v in e.findall("valuestream") if (n := _t(v, "value"))]
    return _given(lookupStep=_t(e, "from", "lookupstep/name"), keyStreamCols=",".join(a for a, _ in keys if a), keyLookupCols=",".join(b for _, b in keys if b), valueFieldCols=",".join(n for n, _ in values), valueRenames=",".join(r for _, r in values))


def _connection(e: ET.Element) -> dict[str, str]:
    kind = (_t(e, "type") or "").upper()
    out = _given(jdbcDriver=_t(e, "driver"), jdbcUrl=_t(e, "jdbcUrl"), jdbcUser=_t(e, "username"), jdbcPassword=_t(e, "password"))
    if "jdbcDriver" not in out and kind in DATABASES:
        out["dbType"] = DATABASES[kind]
    if "jdbcUrl" not in out:
        out |= _given(jdbcHost=_t(e, "server"), jdbcPort=_t(e, "port"), **{"jdbcSid" if kind == "ORACLE" else "jdbcDatabase": _t(e, "database")})
    return out


def _script(e: ET.Element) -> dict[str, str]:
    scripts = [s for x in e.iter("jsScript") if (s := _t(x, "jsScript_script"))]
    rows = [(n, _t(f, "rename") or "") for f in e.findall("fields/field") if (n := _t(f, "name"))]
    return _given(script="\n".join(scripts) or _t(e, "script"), outputFields=",".join(n for n, _ in rows), outputRename=",".join(r for _, r in rows) if any(r for _, r in rows) else None)


def _formula(e: ET.Element) -> dict[str, str]:
    f = next(iter([*e.iter("formula")]), e)
    return _given(fieldName=_t(f, "field_name"), formulaString=_t(f, "formula_string", "formula") or (("".join(f.itertext()).strip() or None) if not len(f) else None))


def _mapping(e: ET.Element) -> dict[str, str]:
    path = _t(e, "filename", "trans_name", "transformationPath")
    return _given(transformationPath=re.sub(r"\.ktr$", ".yaml", path) if path else None)


def _plain(e: ET.Element) -> dict[str, str]:
    return {x.tag: "".join(x.itertext()).strip() for x in e if x.tag not in ("name", "type") and not len(x) and "".join(x.itertext()).strip()}


def _select(e: ET.Element) -> dict[str, str]:
    rows = [(n, _t(f, "rename") or n) for f in e.findall("fields/field") if (n := _t(f, "name"))]
    return _plain(e) | _given(columns=",".join(n for n, _ in rows) or _t(e, "columns"), names=",".join(r for _, r in rows))


def _unique(e: ET.Element) -> dict[str, str]:
    return _plain(e) | _given(columns=",".join(_all(e, "fields/field", "name")) or _t(e, "columns"))


MAPPERS = {
    "CsvInput": _text_input, "TextFileInput": _text_input, "ExcelInput": _text_input, "TextFileOutput": _text_output, "FilterRows": _filter, "SwitchCase": _switch, "Calculator": _calculator,
    "GroupBy": _group, "MemoryGroupBy": _group, "SortRows": _sort, "SortedMerge": _sort, "MergeJoin": _merge_join, "StreamLookup": _lookup, "ScriptValueMod": _script, "Formula": _formula,
    "Mapping": _mapping, "SimpleMapping": _mapping, "SelectValues": _select, "Unique": _unique, "UniqueRowsByHashSet": _unique,
    "TableInput": lambda e: _given(query=_t(e, "sql")), "TableOutput": lambda e: _given(tableName=_t(e, "table"), truncateFirst=_yes(_t(e, "truncate"), "N")),
    "ExcelOutput": lambda e: _given(filePath=_t(e, "file/name", "filename"), sheetName=_t(e, "sheetname", "file/sheetname"), writeHeader=_yes(_t(e, "header"))),
}


def _selected(sql: str | None) -> list[str] | None:
    """Names of a plain SELECT list; None where it can't be told."""
    m = re.match(r"\s*select\s+(.*?)\s+from\b", sql or "", re.I | re.S)
    if not m or re.search(r"[*(]|\bdistinct\b", m[1], re.I):
        return None
    return [re.split(r"\s+as\s+|\s+", x.strip(), flags=re.I)[-1].rpartition(".")[2].strip('"`[]') for x in m[1].split(",")]


def _output_fields(s: StepDefinition, ins: list[list[str] | None]) -> list[str] | None:
    """The fields a step gives, if they can be told."""
    p, first = s.params, ins[0] if ins else None
    names = lambda k: [x.strip() for x in p.get(k, "").split(",") if x.strip()]
    if s.type in _SOURCES:
        return names("fieldNames") or None
    if s.type == "TableInput":
        return _selected(p.get("query"))
    if s.type in ("GroupBy", "MemoryGroupBy"):
        return names("groupColumns") + names("aggNames")
    if s.type == "SelectValues":
        return names("names") or first
    if first is None:
        return None
    if s.type in ("MergeJoin", "MultiwayMergeJoin", "JoinRows"):
        return None if any(i is None for i in ins) else [n for i in ins for n in i]
    if s.type == "StreamLookup":
        main = ins[1 - int(p.get("lookupInputIndex", 1))] if len(ins) > 1 else first
        return None if main is None else main + names("valueRenames")
    if s.type in ("Formula", "Calculator"):
        return [*first, p.get("fieldName", f"f{len(first)}")]
    if s.type == "ScriptValueMod":
        renames = [x.strip() for x in p.get("outputRename", "").split(",")]
        new = [(o, renames[i] if i < len(renames) else "") for i, o in enumerate(names("outputFields"))]
        return first + [r or o for o, r in new if o not in first or (r and r != o)]
    return first


def _resolve(s: StepDefinition, key: str, fields: list[str] | None) -> None:
    if s.params.get(key) and fields:
        s.params[key] = ",".join(str(fields.index(x)) if x in fields else x for x in (y.strip() for y in s.params[key].split(",")))


_POSITIONS = ("column", "columns", "groupColumns", "aggColumns", "colA", "colB", "outputCols", "keyColumns", "valueColumns", "pivotColumn", "valueColumn", "sourceColumn", "targetColumn")


def convert_transformation(xml: str | bytes) -> TransformationDefinition:
    root = _parsed(xml)
    connections = {n: c for c in root.findall("connection") if (n := _t(c, "name"))}
    steps = []
    for e in root.findall("step"):
        kind = _t(e, "type") or ""
        kind = STEP_NAMES.get(kind, kind)
        s = StepDefinition(_t(e, "name") or "", kind, MAPPERS.get(kind, _plain)(e))
        if (inner := e.find("connection")) is not None and kind in ("TableInput", "TableOutput", "InsertUpdate", "Delete", "ExecSQL"):
            s.params |= _connection(inner if len(inner) else connections.get("".join(inner.itertext()).strip(), ET.Element("none")))
            s.params.pop("connection", None)
        steps.append(s)
    by = {s.id: s for s in steps}
    hops = [Hop(f, t, (_t(h, "enabled") or "Y").upper() != "N") for h in root.findall("order/hop") if (f := _t(h, "from")) in by and (t := _t(h, "to")) in by]
    for s in steps:
        look = s.params.get("lookupStep")
        if s.type == "StreamLookup" and look in by and not any((h.from_, h.to) == (look, s.id) for h in hops):
            hops.append(Hop(look, s.id))
    edges = [(h.from_, h.to) for h in hops if h.enabled]
    known: dict[str, list[str] | None] = {}
    for i in topological(list(by), edges):
        s = by[i]
        above = [f for f, t in edges if t == i]
        below = [t for f, t in edges if f == i]
        if s.type == "MergeJoin":
            one, two = s.params.setdefault("step1", above[0] if above else ""), s.params.setdefault("step2", above[1] if len(above) > 1 else "")
            above = [one, two] if {one, two} <= set(above) else above
            hops.sort(key=lambda h: (h.to == i) * (1 + above.index(h.from_) if h.from_ in above else 0)) if sorted(above) == sorted(f for f, t in edges if t == i) else None
        ins = [known.get(a) for a in above]
        if s.type == "FilterRows" and "trueStep" not in s.params and below:
            s.params |= _given(trueStep=below[0], falseStep=below[1] if len(below) > 1 else s.params.get("falseStep"))
        if s.type == "StreamLookup":
            at = above.index(s.params["lookupStep"]) if s.params.get("lookupStep") in above else 1
            s.params["lookupInputIndex"] = str(at)
            names = lambda k, s=s: [x for x in s.params.get(k, "").split(",") if x]
            look = ins[at] if at < len(ins) else None
            look = look or names("keyLookupCols") + names("valueFieldCols")  # an undeclared lookup file: keys, then values
            _resolve(s, "keyStreamCols", ins[1 - at] if len(ins) > 1 else None)
            _resolve(s, "keyLookupCols", look)
            _resolve(s, "valueFieldCols", look)
        elif s.type == "MergeJoin":
            _resolve(s, "leftColumns", ins[0] if ins else None)
            _resolve(s, "rightColumns", ins[1] if len(ins) > 1 else None)
        known[i] = _output_fields(s, ins)
        if s.type in ("Formula", "ScriptValueMod") and ins and ins[0]:
            s.params["fieldNames"] = ",".join(ins[0])
        if s.type not in _SOURCES and ins:
            for k in _POSITIONS:
                _resolve(s, k, ins[0])
    declared = [*root.findall("parameters/parameter"), *root.findall("info/parameters/parameter")]
    parameters = {n: _t(p, "default_value") or "" for p in declared if (n := _t(p, "name"))}
    return TransformationDefinition(_t(root, "info/name", "name") or "", parameters, steps, hops)


def convert_job(xml: str | bytes) -> JobDefinition:
    root = _parsed(xml)
    entries = []
    for e in root.findall("entries/entry"):
        kind = _t(e, "type") or "Unknown"
        if kind.upper() == "SPECIAL":
            kind = next((k for tag, k in (("start", "Start"), ("success", "Success"), ("abort", "Abort"), ("dummy", "Dummy")) if (_t(e, tag) or "").upper() == "Y"), "Success")
        else:
            kind = ENTRY_NAMES.get(kind.upper(), kind)
        path = _t(e, "trans_filename", "filename")
        match kind:
            case "RunTransformation":
                p = _given(transformationPath=re.sub(r"\.ktr$", ".yaml", path) if path else None)
            case "RunJob":
                p = _given(jobPath=re.sub(r"\.kjb$", ".yaml", path) if path else None)
            case "WriteToLog":
                p = _given(message=_t(e, "logmessage"))
            case "ExecSQL":
                p = _given(sql=_t(e, "sql"))
            case "ExecProcess":
                p = _given(command=_t(e, "command", "script"))
            case "FileExists":
                p = _given(filePath=_t(e, "filename"), failIfNoFile=_yes(_t(e, "fail_if_no_file")) if _t(e, "fail_if_no_file") else None)
            case "SetVariable" | "GetVariable":
                p = _given(variableName=_t(e, "variable_name", "fields/field/name", "variableName"), variableValue=_t(e, "variable_value", "fields/field/value", "variableValue"))
            case "Abort":
                p = _given(message=_t(e, "message"))
            case "Mail":
                p = _given(to=_t(e, "destination"), subject=_t(e, "subject"), body=_t(e, "body", "comment"), host=_t(e, "server"), **{"from": _t(e, "from_address", "replyto")})
            case _:
                p = {}
        entries.append(StepDefinition(_t(e, "name") or "", kind, p))
    hops = []
    for h in [*root.iter("jobhop")] or [*root.iter("hop")]:
        if (_t(h, "enabled") or "Y").upper() != "N" and _t(h, "from") and _t(h, "to"):
            always = (_t(h, "unconditional") or "").lower() in ("y", "true")
            failed = (_t(h, "evaluation") or "").lower() in ("n", "false")
            hops.append(Hop(_t(h, "from"), _t(h, "to"), True, "unconditional" if always else "failure" if failed else "success"))
    declared = [*root.findall("parameters/parameter"), *root.findall("info/parameters/parameter")]
    return JobDefinition(_t(root, "name", "info/name") or "", {n: _t(p, "default_value") or "" for p in declared if (n := _t(p, "name"))}, entries, hops)


def convert_project(data: bytes) -> bytes:
    """A zip of XML definitions to a zip of YAML. Names without folders; a job whose name is taken gets a suffix, and
    references to it follow."""
    found: dict[str, TransformationDefinition | JobDefinition] = {}
    renamed: dict[str, str] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        for kind, convert in ((".ktr", convert_transformation), (".kjb", convert_job)):
            for n in names:
                if n.lower().endswith(kind):
                    base = os.path.basename(n.replace("\\", "/"))[: -len(kind)]
                    target, k = f"{base}.yaml", 1
                    while target in found:
                        k += 1
                        target = f"{base}_job.yaml" if k == 2 else f"{base}_job{k - 1}.yaml"
                    if kind == ".kjb":
                        renamed[f"{base}.yaml"] = target
                    found[target] = convert(z.read(n))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in found.items():
            if isinstance(d, JobDefinition):
                for e in d.entries:
                    if e.type == "RunJob" and (path := e.params.get("jobPath")):
                        e.params["jobPath"] = renamed.get(os.path.basename(path), path)
            z.writestr(n, dump(d))
    return out.getvalue()
