"""One entry for every format: `load_table`, and the writers."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from limpid import constants as K
from limpid.functions.numbers import try_number
from limpid.functions.text import is_code, strip
from limpid.operators.aggregate import count_where
from limpid.operators.counts import text_metrics
from limpid.operators.schema import ref, text_columns
from limpid.sources.dialect import UTF8, decoded, dialects, formats, line_numbers, text_lines
from limpid.sources.workbook import read_workbooks
from limpid.storage import materialised

_BY_EXTENSION = {
    ".csv": "csv", ".xlsx": "excel", ".xls": "excel", ".json": "json", ".jsonl": "jsonl",
    ".parquet": "parquet",
}
CORRUPT = "_corrupt_record"
OVERFLOW = "_overflow_"
FILE = "__file"


@dataclass
class Loaded:
    """A table, and what of its files is not in it: file, line_number, kind, text.

    Both come from one stored read of the records, so the list of losses costs no scan of the files.
    """

    table: DataFrame
    losses: DataFrame


def load_with_losses(spark: SparkSession, path: str, fmt: str | None = None) -> Loaded:
    """Read CSV or JSON Lines without stopping at bad records, which are listed instead.

    Of a CSV record with more fields than its header the further ones are listed (by file; a
    record has no line number, as it may span lines). Of JSON Lines, unreadable lines are.
    """
    fmt = fmt or _BY_EXTENSION.get(os.path.splitext(path.rstrip("/"))[1].lower())
    readers = {"csv": _csv_with_losses, "jsonl": _json_lines_with_losses}
    if fmt not in readers:
        raise ValueError(f"no list of losses for format: {fmt}")
    found = readers[fmt](spark, path)
    return Loaded(nested_to_json(found.table), found.losses)


def load_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a file or folder. The format comes from `fmt`, the extension, or the content."""
    fmt = fmt or _BY_EXTENSION.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt is None:
        fmt = sniffed_format(spark, path)
    readers = {
        "csv": read_csv, "json": read_json, "jsonl": read_json_lines, "parquet": read_parquet,
        "excel": read_excel,
    }
    if fmt not in readers:
        raise ValueError(f"unknown format: {fmt}")
    return nested_to_json(readers[fmt](spark, path))


def sniffed_format(spark: SparkSession, path: str) -> str:
    """The one format all files under `path` show; else an error."""
    found = [r["format"] for r in formats(spark, path).select("format").distinct().collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError(f"cannot tell the format of {path}")
    return found[0]


# --- CSV -----------------------------------------------------------------------------


def _header_names(header: bytes, separator: str, encoding: str) -> list[str]:
    """Names of the first record; one that is missing is numbered, a repeated one gets a suffix."""
    text = header.decode(encoding).removeprefix("\ufeff")
    seen, out = {}, []
    for i, name in enumerate(next(csv.reader([text], delimiter=separator), [])):
        name = name or f"_c{i}"
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def _of_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """The rows that were read from the given files (column `_file`)."""
    pathed = df.select("*", F.col("_metadata.file_path").alias("_path"))
    return pathed.join(files, F.col("_path") == F.col("_file"), "left_semi").drop("_path")


def read_csv_text(spark: SparkSession, path: str, ragged: str = "raise", file_as: str | None = None) -> DataFrame:
    """All-text CSV table.

    Files are read in groups that share encoding, separator, header, and whether quoted fields
    hold line breaks (such files cannot be split); columns meet by name. A record with more
    fields than its header is refused, or with `ragged="keep"` its further fields become columns
    `_overflow_1`, `_overflow_2`, ... An unclosed quote is refused. `file_as` names a column for
    the file of each record.
    """
    found = materialised(dialects(spark, path).filter("header is not null"), "csv-dialects")
    groups = (
        found.groupBy("encoding", "separator", "header", (F.col("odd_lines") > 0).alias("breaks"))
        .agg(
            F.count_if(F.col("quotes") % 2 == 1).alias("unclosed"), F.sum("long_rows").alias("long_rows"),
            F.max("most_fields").alias("most"), F.max("fields").alias("fields"),
        )
        .orderBy("encoding", "separator", "header", "breaks")
        .collect()  # a row per dialect
    )
    if n := sum(g["unclosed"] for g in groups):
        raise ValueError(f"{n} file(s) under {path} end inside a quoted field")
    if ragged == "raise" and (n := sum(g["long_rows"] for g in groups if not g["breaks"])):
        raise ValueError(f"{n} record(s) under {path} have more fields than their header")
    parts = []
    for g in groups:
        names = _header_names(bytes(g["header"]), g["separator"], g["encoding"])
        extra = [f"{OVERFLOW}{i + 1}" for i in range(max(g["most"] - g["fields"], int(g["breaks"])))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, *extra)])
        df = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(
            path, header=True, enforceSchema=True, sep=g["separator"], encoding=g["encoding"],
            multiLine=g["breaks"], escape='"', mode="PERMISSIVE",
        )
        if file_as is not None:
            df = df.withColumn(file_as, F.col("_metadata.file_path"))
        if len(groups) > 1:
            same = (
                (F.col("encoding") == g["encoding"]) & (F.col("separator") == g["separator"])
                & (F.col("header") == F.lit(bytes(g["header"]))) & ((F.col("odd_lines") > 0) == g["breaks"])
            )
            files = found.filter(same).select(F.col("path").alias("_file"))
            df = _of_files(df, files)
        if ragged == "raise":
            if g["breaks"] and df.filter(F.col(extra[0]).isNotNull()).limit(1).count():
                raise ValueError(f"records under {path} have more fields than their header")
            df = df.drop(*extra)
        parts.append(df)
    if not parts:
        return spark.createDataFrame([], T.StructType([] if file_as is None else [T.StructField(file_as, T.StringType())]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, ragged: str = "raise") -> DataFrame:
    """Typed CSV table. The files are read twice: for their dialect, and for their records, which
    are stored as text columns; types are decided and cast on those."""
    text = read_csv_text(spark, path, ragged)
    return infer_types(materialised(text, "csv-text")) if text.columns else text


def _csv_with_losses(spark: SparkSession, path: str) -> "Loaded":
    stored = materialised(read_csv_text(spark, path, "keep", FILE), "csv-text")
    extra = [c for c in stored.columns if c.startswith(OVERFLOW)]
    more = F.array_join(F.array(*[ref(c) for c in extra]), "\t") if extra else F.lit(None).cast("string")
    losses = stored.filter(F.coalesce(*[ref(c) for c in extra]).isNotNull() if extra else F.lit(False)).select(
        ref(FILE).alias("file"), F.lit(None).cast("long").alias("line_number"), F.lit("further fields").alias("kind"), more.alias("text")
    )
    kept = stored.select(*[ref(c) for c in stored.columns if c not in (FILE, *extra)])
    return Loaded(infer_types(kept), losses)


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Narrowest type that reads every present cell of each text column.

    A column holding one code with a leading zero stays text, wherever it stands.
    """
    v = F.when(~F.col("value").isin(*K.CSV_NA_TOKENS), F.col("value"))
    m = text_metrics(
        df,
        text_columns(df),
        {
            "present": lambda _: F.count(v),
            "codes": lambda _: count_where(is_code(strip(v))),
            "longs": lambda _: F.count(F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v).try_cast("bigint"))),
            "doubles": lambda _: F.count(try_number(F.trim(v))),
            "booleans": lambda _: count_where(v.isin(*K.CSV_TRUE, *K.CSV_FALSE)),
        },
    )
    out = {}
    for c, n in m.items():
        if not n["present"] or n["codes"]:
            out[c] = "string"
        else:
            kinds = (("bigint", "longs"), ("double", "doubles"), ("boolean", "booleans"))
            out[c] = next((t for t, k in kinds if n[k] == n["present"]), "string")
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """Blank the "no value" tokens and give each text column its inferred type."""
    types = inferred_types(df)
    out = []
    for c in df.columns:
        v = ref(c)
        if c in types:
            v = F.when(~v.isin(*K.CSV_NA_TOKENS), v)
            if types[c] == "boolean":
                v = F.when(v.isin(*K.CSV_TRUE), True).when(v.isNotNull(), False)
            elif types[c] != "string":
                v = F.trim(v).try_cast(types[c])
        out.append(v.alias(c))
    return df.select(*out)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of workbooks, codes kept as text."""
    return infer_types(read_workbooks(spark, path))


# --- JSON ----------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents: lists of objects, or objects whose lists are columns."""
    found = materialised(dialects(spark, path).select("path", "encoding", "opening", "lines"), "json-dialects")
    # A document of one line is read as a line: Spark infers types of lines in as many tasks as it reads
    # them, of whole files in one task for each 128 MB.
    lined = not found.filter((F.col("lines") > 1) | (F.col("encoding") != UTF8)).limit(1).count()
    encodings = sorted(r["encoding"] for r in found.select("encoding").distinct().collect())
    parts = []
    for encoding in encodings:
        reader = spark.read.option("recursiveFileLookup", "true").option("encoding", encoding)
        df = reader.json(path, multiLine=not lined)
        if len(encodings) > 1:
            files = found.filter(F.col("encoding") == encoding).select(F.col("path").alias("_file"))
            df = _of_files(df, files)
        if CORRUPT in df.columns:
            rest = [ref(c) for c in df.columns if c != CORRUPT]
            # Files of another encoding may look damaged here, but those are not of this part.
            if not rest or df.filter(F.col(CORRUPT).isNotNull() & (F.xxhash64(*rest) != 0)).limit(1).count():
                raise ValueError(f"invalid JSON document under {path}")
            df = df.drop(CORRUPT)
        parts.append(df)
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    listed = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.ArrayType)
        and not isinstance(f.dataType.elementType, (T.ArrayType, T.StructType, T.MapType))
    ]
    # Every document opens with a brace, so it is one object and not a list.
    objects = listed and not found.filter("opening <> '{'").limit(1).count()
    return columns_to_rows(df, listed) if objects else df


def columns_to_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Objects of arrays to rows: the i-th elements of all arrays make row i; a key that holds no
    array has its value in each of them."""
    others = [ref(c) for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.arrays_zip(*[ref(c) for c in columns])))


def _json_line_parts(spark: SparkSession, path: str) -> DataFrame:
    """file, block, id, value and the parsed record of each line that is not blank."""
    lines = text_lines(spark, path)
    encodings = dialects(spark, path).select(F.col("path").alias("file"), "encoding")
    if encodings.filter(F.col("encoding") != UTF8).limit(1).count():
        lines = lines.join(encodings, "file").withColumn("value", decoded(F.col("value"), F.col("encoding")))
    reader = spark.read.option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", CORRUPT)
    fields = [f for f in reader.json(path).schema.fields if f.name != CORRUPT]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    filled = F.length(F.trim("value")) > 0
    return lines.withColumn("record", F.when(filled, F.from_json("value", schema, options)))


def _readable(parts: DataFrame) -> DataFrame:
    return parts.filter("record is not null").select("record.*").filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def _json_lines_with_losses(spark: SparkSession, path: str) -> Loaded:
    # The text is kept beside its record only where it is listed.
    bad = F.col(f"record.{CORRUPT}").isNotNull()
    parts = _json_line_parts(spark, path).withColumn("value", F.when(bad, F.col("value")))
    stored = materialised(parts.drop("size"), "json-lines")
    lost = line_numbers(stored).filter(bad).select("file", "line_number", F.lit("unreadable").alias("kind"), F.col("value").alias("text"))
    return Loaded(_readable(stored), lost)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Readable records only; see `load_with_losses` for the others."""
    return _readable(_json_line_parts(spark, path))


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_json_lines` leaves out: file, line_number, line."""
    return _json_lines_with_losses(spark, path).losses.select("file", "line_number", F.col("text").alias("line"))


# --- Parquet, nested cells -----------------------------------------------------------


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nested_to_json(df: DataFrame) -> DataFrame:
    """Lists, maps and structures become JSON text: comparable, nothing lost."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(ref(f.name), {"ignoreNullFields": "false"}).alias(f.name)
            if isinstance(f.dataType, nested)
            else ref(f.name)
            for f in df.schema
        ]
    )


# --- Writers -------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Write the cleaned table, as Parquet or as CSV with a header."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path
