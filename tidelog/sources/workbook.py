"""Minimal reader and writer for one-sheet XLSX files (zip of XML), used inside tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    out = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag == f"{_MAIN}si":
                    out.append(_text(node))
                    node.clear()
    return out


def iter_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as text, row by row; gaps are None. The sheet is parsed as it is read."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_texts(book)
        sheet = min((n for n in book.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        done = 0
        with book.open(sheet) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", done + 1))
                while done < number - 1:
                    done += 1
                    yield []
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells.append(_text(cell))
                    elif value is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(value.text)] if kind == "s" else value.text)
                done += 1
                row.clear()
                yield cells


def read_rows(content: bytes) -> list[list[str | None]]:
    return list(iter_rows(content))


# The parts every workbook package needs.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def write_rows(rows: Iterable[Iterable[object]]) -> bytes:
    """Workbook with one sheet; numbers become numeric cells, text inline strings."""
    body = []
    for i, row in enumerate(rows, 1):
        cells = []
        for value in row:
            if value is None:
                cells.append("<c/>")
            elif isinstance(value, (int, float)):
                cells.append(f"<c><v>{value!r}</v></c>")
            else:
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    sheet = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(body)}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in {**_PARTS, "xl/worksheets/sheet1.xml": sheet}.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
