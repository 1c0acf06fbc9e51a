"""A writer of XLSX workbooks, row by row."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

# Limits and names of the format.
MOST_ROWS = 1_048_576
MOST_LETTERS = 32_767
_NS = "http://schemas.openxmlformats.org"
_MAIN = f'xmlns="{_NS}/spreadsheetml/2006/main"'
_REL = f"{_NS}/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_UNWRITABLE = re.compile(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = escape(_UNWRITABLE.sub("", str(value)[:MOST_LETTERS]))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _name(name: str, k: int) -> str:
    tail = f"_{k + 1}" if k else ""
    return re.sub(r"[\[\]:*?/\\\\]", "_", name)[: 31 - len(tail)] + tail


def workbook(path: str, sheets: dict[str, tuple[list[str], Iterable]], most_rows: int = MOST_ROWS) -> None:
    """Write sheets (header, rows); rows past the format's limit go on in a further sheet.

    Text past the format's limit for a cell is cut. Only one row is held at a time.
    """
    names: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, (header, rows) in sheets.items():
            source: Iterator = iter(rows)
            row, k = next(source, None), 0
            while not k or row is not None:
                names.append(_name(name, k))
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    out.write(f"{_HEAD}<worksheet {_MAIN}><sheetData><row>{''.join(map(_cell, header))}</row>".encode())
                    n = 1
                    while row is not None and n < most_rows:
                        out.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                        row, n = next(source, None), n + 1
                    out.write(b"</sheetData></worksheet>")
                k += 1
        listed = "".join(f'<sheet name={quoteattr(x)} sheetId="{i}" r:id="r{i}"/>' for i, x in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        package = f"{_NS}/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{package}/content-types">{kinds}<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}</Types>')
