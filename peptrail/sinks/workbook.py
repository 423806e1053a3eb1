"""Workbooks in the Office Open XML format, written row by row with the standard library."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

from peptrail.checks import DataError
from peptrail.sinks.folders import Folder, _place

CELL_CHARS = 32_760
#: parts of column names whose numbers are shares and show as percentages
SHARES = ("abundance", "coverage", "breadth", "fraction", "purity", "prevalence", "weight", "missing_reference")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


@dataclass
class Sheet:
    title: str
    columns: Sequence[str]
    rows: Iterable[Sequence]


def column_letters(n: int) -> str:
    """A, B, .., Z, AA, .. for 1, 2, .."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: str, value: object, style: int) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr" s="{style if style == 2 else 0}"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value))[:CELL_CHARS])}</t></is></c>'


def _write_sheet(book: zipfile.ZipFile, number: int, sheet: Sheet) -> None:
    letters = [column_letters(k + 1) for k in range(len(sheet.columns))]
    share = [1 if any(m in name.lower() for m in SHARES) else 0 for name in sheet.columns]
    with book.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as f:
        put = lambda text: f.write(text.encode())
        widths = "".join(f'<col min="{k}" max="{k}" width="{min(48, max(16, len(c) + 2))}" customWidth="1"/>' for k, c in enumerate(sheet.columns, 1))
        put(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>')
        put(f'<row r="1">{"".join(_cell(f"{a}1", c, 2) for a, c in zip(letters, sheet.columns, strict=True))}</row>')
        at = 1
        for at, row in enumerate(sheet.rows, 2):
            cells = "".join(_cell(f"{a}{at}", v, s if isinstance(v, float) else 0) for a, v, s in zip(letters, row, share, strict=True))
            put(f'<row r="{at}">{cells}</row>')
        put(f'</sheetData><autoFilter ref="A1:{letters[-1]}{at}"/></worksheet>')


def write_workbook_file(path, sheets: Sequence[Sheet]) -> None:
    titles = [re.sub(r"[\[\]:*?/\\]", " ", s.title)[:31] for s in sheets]
    if len({t.lower() for t in titles}) < len(titles):
        raise DataError("two sheets have one title")
    numbers = range(1, len(sheets) + 1)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers) + "</Types>")
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, t in zip(numbers, titles, strict=True)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{_DOCUMENT}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF30506E"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="164" applyNumberFormat="1"/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>')
        for k, sheet in zip(numbers, sheets, strict=True):
            _write_sheet(book, k, sheet)


def write_sheets(folder: Folder, name: str, sheets: Sequence[Sheet]) -> None:
    """Make a workbook beside the driver, then put it into the folder under a passing name and rename it."""
    with tempfile.NamedTemporaryFile(suffix=".xlsx") as held:
        write_workbook_file(held.name, sheets)
        passing, path = (_place(folder.spark, folder.uri(n))[1] for n in (f".{uuid.uuid4().hex}", name))
        local = folder.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{held.name}")
        folder.store.copyFromLocalFile(False, True, local, passing)
        folder.store.delete(path, False)
        if not folder.store.rename(passing, path):
            raise DataError(f"{name} could not be written")
