"""Workbooks (.xlsx) by the standard library: a zip of XML parts."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import urlparse
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.registry import Context, Params, step
from millrace.sources.files import local_path

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _java_double(v: float) -> str:
    """A number as Java prints it."""
    if v == int(v) and 1e-3 <= abs(v) < 1e7 or v == 0:
        return f"{v:.1f}"
    if 1e-3 <= abs(v) < 1e7:
        return repr(v)
    m, e = f"{v!r}e0".split("e")[:2] if "e" not in repr(v) else repr(v).split("e")
    if "e" not in repr(v):
        digits = f"{v:.17g}"
        m, e = f"{float(digits):e}".split("e")
        m = repr(float(digits) / 10 ** int(e))
    return f"{float(m)}E{int(e)}"


def read_workbook(path: str) -> dict[str, list[list[str | None]]]:
    """Rows of each sheet as texts: numbers as doubles, booleans as true/false, blanks null."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = rels[s.get(_REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str | None]] = []
            for r in root.iter(f"{{{_NS['m']}}}row"):
                row: list[str | None] = []
                for cell in r.findall("m:c", _NS):
                    if ref := re.match("[A-Z]+", cell.get("r", "")):
                        at = 0
                        for x in ref[0]:
                            at = at * 26 + ord(x) - 64
                        row += [None] * (at - 1 - len(row))
                    v, kind = cell.find("m:v", _NS), cell.get("t", "n")
                    if kind == "inlineStr":
                        row.append("".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")))
                    elif v is None or v.text is None:
                        row.append(None)
                    elif kind == "s":
                        row.append(shared[int(v.text)])
                    elif kind == "b":
                        row.append("true" if v.text == "1" else "false")
                    else:
                        row.append(v.text if kind in ("str", "e") else _java_double(float(v.text)))
                rows.append(row)
            out[s.get("name")] = rows
    return out


def write_workbook(path: str, sheets: dict[str, list[list[str | None]]]) -> None:
    def cell(v: str | None) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>'

    m = _NS["m"]
    names = list(sheets)
    part = path + ".part"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{m}" xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{m}"><sheetData>'.encode())
                for row in sheets[n]:
                    f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    os.replace(part, path)


@step("ExcelInput", source=True)
def excel_input(ins: list[Frame], p: Params, c: Context) -> Frame:
    path = local_path(p.required("filePath"), p, c)
    book = read_workbook(urlparse(path).path if path.startswith("file:") else path)
    name = p.text("sheetName") or next(iter(book))
    if name not in book:
        raise ValueError(f"no sheet {name!r}")
    rows = book[name]
    width = max(map(len, rows), default=1) or 1
    rows = [r + [None] * (width - len(r)) for r in rows]
    head = rows[0] if rows and p.flag("hasHeader", True) else []
    names = [h or f"f{i}" for i, h in enumerate(head)] or [f"f{i}" for i in range(width)]
    body = [(i, *r) for i, r in enumerate(rows[1:] if head else rows)]
    df = c.spark.createDataFrame(body, "at long, " + ", ".join(f"v{i} string" for i in range(width)))
    return Frame.of(df, ["at"]).put([F.col(f"c{i + 1}") for i in range(width)], names)


def _rows(f: Frame) -> list[list[str | None]]:
    """A workbook holds about a million rows a sheet, so its rows fit the driver."""
    return [[None if v is None else str(v) for v in r] for r in f.sorted().select(*[x.cast("string") for x in f.fields()]).limit(1_048_577).toLocalIterator()]


def _checked(rows: list, had: int = 0, most: int = 1_048_576) -> list:
    """`had` counts the sheet's rows so far and its header."""
    if len(rows) + had > most:
        raise ValueError("more rows than a sheet can hold")
    return rows


@step("ExcelOutput", effect=True, narrow=True)
def excel_output(ins: list[Frame], p: Params, c: Context) -> Frame:
    rows = _rows(ins[0])
    head = [[f"col{i}" for i in range(ins[0].width)]] if rows and p.flag("writeHeader", True) else []
    _checked(rows, len(head))
    write_workbook(p.required("filePath"), {p.text("sheetName", "Sheet1"): head + rows})
    return ins[0]


@step("TypeExitExcelWriter", effect=True, narrow=True)
def excel_append(ins: list[Frame], p: Params, c: Context) -> Frame:
    path = p.required("filePath")
    if not os.path.exists(path):
        raise ValueError(f"no workbook {path}")
    book = read_workbook(path)
    sheet = book.setdefault(p.text("sheetName") or next(iter(book)), [])
    rows = _rows(ins[0])
    if not sheet and rows and p.flag("writeHeader", True):
        sheet.append([f"col{i}" for i in range(ins[0].width)])
    sheet += _checked(rows, len(sheet))
    write_workbook(path, book)
    return ins[0]
