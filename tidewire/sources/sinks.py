"""Sinks: exports of a result in five formats, and cleaned export rows.

Exports are of at most ``EXPORT_LIMIT`` rows, so writers stream them from the driver row by row.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

EXPORT_LIMIT = 2000
_CONTROL = r"[\x00-\x09\x0b-\x1f]"


def clean(column: str, kind: str) -> Column:
    """A cell as text: lists joined, moments to the minute, control characters but line ends cut."""
    c = F.col(column)
    if kind.startswith("array"):
        c = F.array_join(c, ", ")
    elif kind.startswith("timestamp"):
        c = F.date_format(c, "yyyy-MM-dd HH:mm")
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _CONTROL, "")


def export_rows(found: DataFrame) -> DataFrame:
    kinds = dict(found.dtypes)
    return found.select(
        "id", clean("title", kinds["title"]).alias("title"), F.col("name").alias("source"), "url", "country", "language", "importance",
        clean("published_at", kinds["published_at"]).alias("published"), clean("summary", kinds["summary"]).substr(1, 400).alias("summary"),
    ).limit(EXPORT_LIMIT)


#: Columns of a full export and their headings, fixed values.
COLUMNS = (
    ("title", "Title"), ("published_at", "Published (UTC)"), ("source", "Outlet"), ("country", "Country"), ("categories", "Categories"), ("importance", "Importance"),
    ("scope", "Scope"), ("language", "Language"), ("event_id", "Story"), ("summary", "Summary"), ("url", "Link"),
)


def export_table(found: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """The full export of a ranked result, all cells as text. found: the columns of COLUMNS with name for source, and id; translations: article_id, title, summary."""
    if translations is not None:
        t = translations.select(F.col("article_id").alias("id"), F.nullif("title", F.lit("")).alias("t_title"), F.nullif("summary", F.lit("")).alias("t_summary"))
        found = found.join(t, "id", "left").withColumns({"title": F.coalesce("t_title", "title"), "summary": F.coalesce("t_summary", "summary")})
    kinds = dict(found.dtypes)
    cell = lambda c: F.btrim(clean(c, kinds[c]), F.lit(" \n"))
    return found.select(*[cell("name" if c == "source" else c).alias(c) for c, _ in COLUMNS]).limit(EXPORT_LIMIT)


def to_csv(rows: DataFrame) -> bytes:
    """UTF-8 with a byte order mark and CRLF line ends; a full export has its headings."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(_headings(rows))
    for row in rows.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def _headings(rows: DataFrame) -> list[str]:
    return [h for _, h in COLUMNS] if rows.columns == [c for c, _ in COLUMNS] else rows.columns


def _facts(row: dict) -> str:
    at = row.get("published") or row.get("published_at")
    importance = f"importance {row['importance']}" if row.get("importance") not in (None, "") else ""
    return " · ".join(str(x) for x in (row.get("source"), at, row.get("country"), row.get("categories"), importance) if x)


def to_markdown(name: str, rows: DataFrame) -> str:
    parts = [f"# {name}\n"]
    for r in map(Row.asDict, rows.toLocalIterator()):
        head = f"## [{r['title']}]({r['url']})" if r["url"] else f"## {r['title']}"
        parts.append(f"{head}\n*{_facts(r)}*\n\n{r['summary']}\n")
    return "\n".join(parts)


def to_json(name: str, rows: DataFrame, at: datetime) -> str:
    found = [r.asDict() for r in rows.toLocalIterator()]
    return json.dumps({"feed": name, "exported_at": at.isoformat(), "count": len(found), "articles": found}, ensure_ascii=False)


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _package(main: str, kind: str, parts: dict[str, str]) -> bytes:
    overrides = "".join(f'<Override PartName="/{p}" ContentType="{t}"/>' for p, t in ((main, kind), *((p, t) for p, t in _TYPES.items() if p in parts)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>')
        z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>')
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_TYPES = {"xl/worksheets/sheet1.xml": f"{_SHEET}.worksheet+xml"}


def to_xlsx(rows: DataFrame) -> bytes:
    def line(values) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>"

    data = "".join([line(_headings(rows)), *(line(r) for r in rows.toLocalIterator())])
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return _package("xl/workbook.xml", f"{_SHEET}.sheet.main+xml", {
        "xl/workbook.xml": f'{_XML}<workbook xmlns="{ns}" xmlns:r="{_OFFICE}"><sheets><sheet name="articles" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_XML}<Relationships xmlns="{_RELS}"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{_XML}<worksheet xmlns="{ns}"><sheetData>{data}</sheetData></worksheet>',
    })


def to_docx(name: str, rows: DataFrame) -> bytes:
    def paragraph(text: str, bold: bool = False) -> str:
        return f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = [paragraph(name, True)]
    for r in map(Row.asDict, rows.toLocalIterator()):
        body += [paragraph(r["title"] or "", True), paragraph(_facts(r)), paragraph(r["summary"] or "")]
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    return _package("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", {
        "word/document.xml": f'{_XML}<w:document xmlns:w="{ns}"><w:body>{"".join(body)}</w:body></w:document>',
    })
