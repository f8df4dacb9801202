"""Column expressions and checks that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """White-space separated words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves `remainder`; a null id is never held out."""
    rest = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def quoted(names) -> list[Column]:
    """Columns by their exact names, whatever characters those hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def rows_kept(docs: DataFrame, run) -> DataFrame:
    """`docs` through a batch function that drops rows; it sees every column under a plain name."""
    plain = docs.toDF(*[n if n == "text" else f"c{i}" for i, n in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
