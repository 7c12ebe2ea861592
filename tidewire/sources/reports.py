"""Reports in Word files or plain text as documents with topics: headings, what stands below them, links."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Characters of a heading, of a heading before a colon, of a body; lines that templates put on every report; fixed values.
HEADING, BEFORE_COLON, MOST_BODY = (15, 180), (20, 170), 600
TEMPLATE_LINES = re.compile(r"^(weekly intel|weekly report|internal information|additional context|sources?$|summary$|overview$|bluf|prepared by|table of contents|contents$|classification)", re.I)
_DATE_LINE = re.compile(r"^(?:\d{1,2}\s+\w+|\w+\s+\d{1,2},?)\s+20\d{2}$")
_URL = re.compile(r"https?://[^\s\"<>\])]+")
TOPICS = "array<struct<heading:string,body:string,links:array<string>>>"


def word_paragraphs(data: bytes) -> list[dict]:
    """Text, bold share of the letters, bold beginning and links of each paragraph of a Word file, headers first; none if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names, out = set(z.namelist()), []
            for part in ("word/header1.xml", "word/header2.xml", "word/header3.xml", "word/document.xml"):
                if part not in names:
                    continue
                rels = part.replace("word/", "word/_rels/") + ".rels"
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(rels))} if rels in names else {}
                out += [_paragraph(p, targets) for p in ElementTree.fromstring(z.read(part)).iter(f"{_WORD}p")]
            return out
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []


def _paragraph(p, targets: dict) -> dict:
    runs = [("".join(t.text or "" for t in r.iter(f"{_WORD}t")), r.find(f"{_WORD}rPr/{_WORD}b") is not None) for r in p.iter(f"{_WORD}r")]
    letters, start = sum(len(t) for t, _ in runs), ""
    for text, bold in runs:
        if not bold:
            break
        start += text
    links = [targets.get(h.get(_LINK)) for h in p.iter(f"{_WORD}hyperlink")]
    return {"text": " ".join("".join(t for t, _ in runs).split()), "bold": sum(len(t) for t, b in runs if b) > 0.6 * letters > 0, "start": len(" ".join(start.split())), "links": [x for x in links if x and x.startswith("http")]}


def text_paragraphs(text: str) -> list[dict]:
    """The same of plain text, where ** marks bold words."""
    out = []
    for line in text.splitlines():
        bold = re.match(r"^[-*•\s]*\*\*(.+?)\*\*:?\s*(.*)$", line.strip())
        out.append({"text": " ".join(line.replace("**", "").split()), "bold": bool(bold and not bold[2]), "start": len(bold[1]) if bold else 0, "links": _URL.findall(line)})
    return out


def topics_of(paragraphs: list[dict]) -> list[dict]:
    """Topics in order: bold headings with what follows, or, where a report has none, bold beginnings before a colon."""
    headed, inline, current = [], [], None
    for p in paragraphs:
        text = p["text"]
        if not text:
            continue
        if TEMPLATE_LINES.match(text) or _DATE_LINE.match(text):
            current = None
        elif p["bold"] and HEADING[0] <= len(text) <= HEADING[1]:
            current = {"heading": text.rstrip(": "), "body": "", "links": list(p["links"])}
            headed.append(current)
        elif BEFORE_COLON[0] <= (at := text.find(": ")) <= BEFORE_COLON[1] and 2 * p["start"] >= at:
            inline.append({"heading": text[:at].rstrip(": "), "body": text[at + 2 :], "links": list(p["links"])})
        elif current:
            current["body"] = f"{current['body']} {text}".strip() if len(current["body"]) < 60 else current["body"]
            current["links"] += p["links"]
    found = headed if len(headed) > 1 or (headed and not inline) else inline
    return [{"heading": t["heading"], "body": t["body"][:MOST_BODY], "links": list(dict.fromkeys(t["links"]))} for t in found]


def reports(spark: SparkSession, path: str) -> DataFrame:
    """path and topics of each Word or text file in a folder; like topics are still apart (``operators.documents.topics`` merges them)."""
    ship(spark)

    @F.pandas_udf(TOPICS)
    def read(names: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([topics_of(word_paragraphs(d) if n.lower().endswith(".docx") else text_paragraphs(d.decode("utf-8", "replace"))) for n, d in zip(names, data)])

    return spark.read.format("binaryFile").load(path).select("path", read("path", "content").alias("topics"))
