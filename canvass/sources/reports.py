"""Report files: JSON, CSV, HTML and Excel, with the findings streamed through the driver."""

from __future__ import annotations

import csv
import html
import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from ..operators.summary import ReportData
from ..plans.codebook import Severity

FIELDS = ("rule_id", "severity", "message", "row_index", "variables")


class JsonReport:
    def build(self, data: ReportData, path: str | Path) -> Path:
        path = Path(path)
        summary = {
            "total": data.total, "by_severity": {s.value: data.severities[s] for s in Severity},
            "by_rule": [{"rule_id": r.rule_id, "severity": r.severity.value, "count": r.count} for r in data.rules],
        }
        with path.open("w", encoding="utf-8") as f:
            f.write(f'{{"generated_at": {json.dumps(data.generated_at.isoformat())}, "summary": {json.dumps(summary)}, "results": [')
            for k, row in enumerate(data.rows()):
                f.write((",\n" if k else "\n") + json.dumps({c: row[c] for c in FIELDS}))
            f.write("\n]}\n")
        return path


class CsvReport:
    def build(self, data: ReportData, path: str | Path) -> Path:
        path = Path(path)
        with path.open("w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            out.writerow(FIELDS)
            for row in data.rows():
                out.writerow([*[row[c] for c in FIELDS[:-1]], ";".join(row["variables"])])
        return path


def _cells(values: Iterable[object], tag: str = "td", classes: dict[int, str] | None = None) -> str:
    marks = classes or {}
    return "".join(f'<{tag}{f" class={chr(34)}{marks[k]}{chr(34)}" if k in marks else ""}>{html.escape(str(v))}</{tag}>' for k, v in enumerate(values))


class HtmlReport:
    def build(self, data: ReportData, path: str | Path) -> Path:
        path = Path(path)
        with path.open("w", encoding="utf-8") as f:
            f.write('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Validation report</title></head><body>\n')
            f.write(f"<h1>Validation report</h1>\n<p>Generated at {html.escape(data.generated_at.isoformat())}</p>\n<p>Total findings: {data.total}</p>\n")
            f.write(f"<h2>Summary by rule</h2>\n<table><tr>{_cells(('Rule', 'Severity', 'Count'), 'th')}</tr>\n")
            for r in data.rules:
                f.write(f'<tr class="summary-row">{_cells((r.rule_id, r.severity.value, r.count), classes={1: f"severity-{r.severity.value}"})}</tr>\n')
            f.write(f"</table>\n<h2>Details</h2>\n<table><tr>{_cells(('Rule', 'Severity', 'Message', 'Row', 'Variables'), 'th')}</tr>\n")
            for row in data.rows():
                values = [*[row[c] for c in FIELDS[:-1]], ", ".join(row["variables"])]
                f.write(f'<tr class="result-row">{_cells(values, classes={1: "severity-" + row["severity"]})}</tr>\n')
            f.write("</table>\n</body></html>\n")
        return path


#: Fixed parts of an Excel workbook with two sheets and inline text.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_FRAME = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet2.xml" ContentType="{_TYPES}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Summary" sheetId="1" r:id="rId1"/><sheet name="Details" sheetId="2" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
}


def _excel_row(values: Iterable[object]) -> str:
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_printable(str(v)))}</t></is></c>'
    return "<row>" + "".join(cell(v) for v in values) + "</row>"


def _printable(text: str) -> str:
    return "".join(c for c in text if c >= " " or c in "\t\n\r")


class ExcelReport:
    """A workbook with the sheets Summary and Details, written without any other package."""

    def build(self, data: ReportData, path: str | Path) -> Path:
        path = Path(path)
        top = [("Generated at", data.generated_at.isoformat()), ("Total findings", data.total), (), ("Rule", "Severity", "Count")]
        summary = [*top, *[(r.rule_id, r.severity.value, r.count) for r in data.rules]]
        details = (([row[c] for c in FIELDS[:-1]] + [", ".join(row["variables"])]) for row in data.rows())
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _FRAME.items():
                z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
            for n, (head, rows) in enumerate((((), summary), (("Rule", "Severity", "Message", "Row", "Variables"), details)), 1):
                with z.open(f"xl/worksheets/sheet{n}.xml", "w") as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    if head:
                        f.write(_excel_row(head).encode())
                    for row in rows:
                        f.write(_excel_row(row).encode())
                    f.write(b"</sheetData></worksheet>")
        return path
