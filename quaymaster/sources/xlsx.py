"""Workbooks with the standard library: one sheet written, all sheets read."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

MAX_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def _cell(at: str, value: object) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(value)))}</t></is></c>'


def write_sheet(name: str, header: list[str], rows: list[list]) -> bytes:
    body = "".join(f'<row r="{r}">' + "".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([header, *rows], 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _place(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheets(data: bytes) -> dict[str, list[list]]:
    """Rows of cells (text, number or None) of every sheet, by its name."""
    ns = {"m": _MAIN}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
            target = targets[sheet.get(f"{{{_REL}}}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_MAIN}}}row"):
                cells: list = []
                for c in row.findall("m:c", ns):
                    at = _place(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, v = c.get("t"), c.findtext("m:v", None, ns)
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
                    elif v is not None:
                        cells[at] = shared[int(v)] if kind == "s" else v if kind in ("str", "b", "e") else float(v) if re.search("[.eE]", v) else int(v)
                rows.append(cells)
            sheets[sheet.get("name")] = rows
    return sheets


def named_column(sheets: dict[str, list[list]], sheet: str, column: str) -> list[str]:
    """Stripped, non-blank texts under a header; none if the sheet or the header is missing."""
    rows = sheets.get(sheet) or [[]]
    if column not in rows[0]:
        return []
    at = rows[0].index(column)
    values = [str(r[at]).strip() for r in rows[1:] if len(r) > at and r[at] is not None]
    return [v for v in values if v]
