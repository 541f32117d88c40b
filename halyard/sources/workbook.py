"""Workbooks (Office Open XML) read and written with the standard library. They are edge formats of a few sheets that people
fill in; a sheet is held in the driver, and LIMIT says how large it may be."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.etree import ElementTree as E
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

LIMIT = 1_000_000  # cells of a sheet
# fixed values: name spaces and parts of the format
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_N = {"m": _MAIN, "r": _REL, "p": f"{_PACK}/relationships"}

Cells = list[list[str | None]]


def _column(ref: str) -> int:
    at = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def read_sheets(path: str) -> dict[str, Cells]:
    """The sheets of a workbook by name, as rows of texts; empty cells are None, and rows are as long as their last cell."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in E.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _N)]
        rels = {r.get("Id"): r.get("Target") for r in E.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", _N)}
        out = {}
        for sheet in E.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _N):
            target = rels[sheet.get(f"{{{_REL}}}id")].lstrip("/")
            rows: Cells = []
            for row in E.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iterfind("m:sheetData/m:row", _N):
                place = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(place - len(rows))]
                line = rows[place - 1]
                for cell in row.findall("m:c", _N):
                    at = _column(cell.get("r")) if cell.get("r") else len(line)
                    line += [None] * (at + 1 - len(line))
                    value, kind = cell.find("m:v", _N), cell.get("t")
                    if kind == "inlineStr":
                        line[at] = "".join(t.text or "" for t in cell.iter(f"{{{_MAIN}}}t"))
                    elif value is not None:
                        line[at] = shared[int(value.text)] if kind == "s" else value.text
            out[sheet.get("name")] = rows
        return out


def write_sheets(path: str, sheets: dict[str, Iterable[Iterable]]) -> None:
    """A workbook of several sheets, whole or not at all. Numbers are numbers, None is an empty cell, all else is text."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))}</t></is></c>'

    tmp = Path(f"{path}.tmp")
    names = [re.sub(r"[\[\]:*?/\\]", "_", n)[:31] for n in sheets]  # what the format allows
    if len(set(names)) < len(names):
        raise ValueError("sheets have one name")
    kind = f"{_REL}/worksheet"
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{kind}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    tmp.replace(path)


def _frame(spark: SparkSession, rows: Cells, names: list[str]) -> DataFrame:
    if len(rows) * len(names) > LIMIT:
        raise ValueError(f"a sheet of more than {LIMIT} cells")
    return spark.createDataFrame([tuple((*r, *[None] * len(names))[: len(names)]) for r in rows], ", ".join(f"`{n}` string" for n in names))


def sheet(spark: SparkSession, path: str, names: list[str], skip: int = 0, name: str | None = None) -> DataFrame:
    """A sheet (the first, or one by name) by position, all as text, without its first `skip` rows and without empty rows."""
    sheets = read_sheets(path)
    rows = sheets[name] if name else next(iter(sheets.values()))
    return _frame(spark, [r for r in rows[skip:] if any(v not in (None, "") for v in r)], names)


def anchored(spark: SparkSession, path: str, anchor: str, offsets: dict[str, tuple[int, int]], sheets: str = r"\d+") -> DataFrame:
    """sheet and a column for each of offsets: of every sheet whose name is `sheets`, the cells at (row, column) from the first
    row whose first cell begins with the anchor; sheets without it are left out, cells beyond a row are null."""
    found = []
    for name, rows in read_sheets(path).items():
        if not re.fullmatch(sheets, name):
            continue
        at = next((k for k, r in enumerate(rows) if r and str(r[0] or "").startswith(anchor)), None)
        if at is not None:
            get = lambda down, right: rows[at + down][right] if 0 <= at + down < len(rows) and right < len(rows[at + down]) else None  # noqa: E731, B023
            found.append([name, *(get(*o) for o in offsets.values())])
    return _frame(spark, found, ["sheet", *offsets])


def best_filled(spark: SparkSession, path: str, key: str, candidates: tuple[str, ...], headers: int = 2) -> DataFrame:
    """key, value, source: of the columns whose header (any of its first rows) holds one of the candidates, that with the most
    filled cells; the first of equals. Without any there are no rows."""
    rows = next(iter(read_sheets(path).values()))
    width = max([len(r) for r in rows] or [0])
    title = lambda c: " ".join(str(r[c]) for r in rows[:headers] if c < len(r) and r[c] is not None)
    body = rows[headers:]
    cell = lambda r, c: r[c].strip() if c < len(r) and r[c] and r[c].strip() else None
    keys = [c for c in range(width) if key.lower() in title(c).lower()]
    able = [(sum(cell(r, c) is not None for r in body), -c) for c in range(width) if any(w.lower() in title(c).lower() for w in candidates)]
    if not keys or not able:
        return _frame(spark, [], ["key", "value", "source"])
    best = -max(able)[1]
    return _frame(spark, [[cell(r, keys[0]), cell(r, best), title(best)] for r in body if cell(r, keys[0]) is not None], ["key", "value", "source"])
