"""Files in other formats, written by Spark from the given tables, for the reader queries."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from limpid.constants import DELIMITERS
from limpid.storage import new_path

# Rows of one made document: documents stay small however large the table is.
ROWS_PER_DOCUMENT = 500


def csv_dialects(df: DataFrame, text: str) -> str:
    """The table written once per separator and encoding, each time in its own folder. The column
    `text` gets an accent, so that the encodings differ."""
    folder = new_path(df.sparkSession, "dialects")
    accented = df.withColumn(text, F.concat(text, F.lit(" é")))
    for i, sep in enumerate(DELIMITERS):
        for encoding in ("UTF-8", "ISO-8859-1"):
            options = {"header": True, "sep": sep, "encoding": encoding}
            accented.write.options(**options).csv(f"{folder}/{i}-{encoding}")
    return folder


def csv_lines(df: DataFrame, header: str, *cells) -> str:
    """Lines of comma-separated cells under a header, in files as Spark makes them."""
    folder = new_path(df.sparkSession, "csv-lines")

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    df.select(F.concat_ws(",", *cells).alias("value")).mapInPandas(with_header, "value string").write.text(folder)
    return folder


def json_mixed(df: DataFrame, key: str, columns: list[str]) -> str:
    """One JSON object per block of keys: the block's number, and a list for each column."""
    folder = new_path(df.sparkSession, "mixed")
    block = F.floor(F.col(key) / ROWS_PER_DOCUMENT)
    grouped = df.groupBy(block.alias("batch")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    body = F.struct("batch", *[F.col(f"rows.{c}").alias(c) for c in columns])
    grouped.select("batch", F.to_json(body).alias("value")).write.partitionBy("batch").text(folder)
    return folder


def json_documents(df: DataFrame, key: str, columnar: bool) -> str:
    """One JSON document per block of keys: a list of objects, or an object of lists."""
    folder = new_path(df.sparkSession, "documents")
    block = F.floor(F.col(key) / ROWS_PER_DOCUMENT)
    rows = F.collect_list(F.struct(*df.columns))
    grouped = df.groupBy(block.alias("block")).agg(rows.alias("rows"))
    body = F.struct(*[F.col(f"rows.{c}").alias(c) for c in df.columns]) if columnar else F.col("rows")
    grouped.select("block", F.to_json(body).alias("value")).write.partitionBy("block").text(folder)
    return folder


def json_lines_with_damage(df: DataFrame, key: str, every: int = 50) -> str:
    """JSON lines in which every 50th key's record is cut short."""
    folder = new_path(df.sparkSession, "lines")
    line = F.to_json(F.struct(*df.columns))
    cut = F.col(key) % every == 0
    df.select(F.when(cut, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(folder)
    return folder


def _sheet(pdf: pd.DataFrame) -> bytes:
    """A minimal workbook: header row, numbers as numbers, everything else inline text."""

    def cell(v) -> str:
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return "<c/>" if pd.isna(v) else f"<c><v>{v!r}</v></c>" if isinstance(v, float) else f"<c><v>{v}</v></c>"

    lines = [list(pdf.columns), *pdf.itertuples(index=False, name=None)]
    body = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in lines)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{pkg}"><Relationship Id="r1" Type="{rel}/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _books(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    data = pdf.drop(columns="block")
    return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "content": [_sheet(data)]})


def workbooks(df: DataFrame, key: str) -> DataFrame:
    """(path, content) of one workbook per block of keys."""
    block = F.floor(F.col(key) / ROWS_PER_DOCUMENT).alias("block")
    return df.select("*", block).groupBy("block").applyInPandas(_books, "path string, content binary")
