"""First sheet of .xlsx workbooks, one workbook per task.

The format caps a sheet at about a million rows, so one task can hold one. Only
the standard library is needed: a workbook is a zip of XML parts.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that display a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_CELLS = "path string, row_number long, cells map<string,string>"
_ROWS_PER_BATCH = 5000


def _column_index(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in root.iterfind("m:si", _NS)]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iterfind(".//m:numFmt", _NS)
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)
    }
    xfs = root.find("m:cellXfs", _NS)
    return {
        i
        for i, xf in enumerate(xfs if xfs is not None else [])
        if int(xf.get("numFmtId") or 0) in _DATE_FORMATS | custom
    }


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(_REL))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cell(c: ET.Element, strings: list[str], dates: set[int]) -> str | None:
    kind = c.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
    value = c.findtext("m:v", None, _NS)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind is None and int(c.get("s") or 0) in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(value))
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    return value


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet, as text cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _strings(book), _date_styles(book)
        with book.open(_first_sheet(book)) as part:
            for _, element in ET.iterparse(part):
                if element.tag.endswith("}row"):
                    row: list[str | None] = []
                    for c in element.iterfind("m:c", _NS):
                        at = _column_index(c.get("r")) if c.get("r") else len(row)
                        row.extend([None] * (at + 1 - len(row)))
                        row[at] = _cell(c, strings, dates)
                    element.clear()
                    yield row


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            header, rows, number = None, [], 0
            for row in sheet_rows(content):
                if header is None:
                    header = [v if v not in (None, "") else f"Unnamed: {i}" for i, v in enumerate(row)]
                    rows.append((path, 0, {h: h for h in header}))
                    continue
                if all(v is None for v in row):
                    continue
                number += 1
                row = row + [None] * (len(header) - len(row))
                rows.append((path, number, dict(zip(header, row))))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=["path", "row_number", "cells"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "row_number", "cells"])


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All-text table of the first sheets under `path`; columns are matched by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return workbook_rows(files.select("path", "content"))


def workbook_rows(files: DataFrame) -> DataFrame:
    """The same from a table of (path, content)."""
    cells = files.mapInPandas(_workbooks, _CELLS)
    # Row 0 of each workbook is its header; names are few, and kept in the order of the first workbook that has them.
    names = [
        r["name"]
        for r in cells.filter("row_number = 0")
        .select("path", F.posexplode(F.map_keys("cells")).alias("at", "name"))
        .groupBy("name")
        .agg(F.min(F.struct("path", "at")).alias("first"))
        .orderBy("first")
        .collect()
    ]
    return cells.filter("row_number > 0").select(
        *[F.col("cells")[n].alias(n) for n in names]
    )
