"""Format, encoding and separator of each file, from all of its lines.

Spark reads the lines, so any file system it reads will do, and every byte counts: a file is
UTF-8 only if each of its lines is. Lines are counted by their numbers of separators in each
task; only those counts are shuffled.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from limpid import constants as K
from limpid.storage import materialised

UTF8, WINDOWS, LATIN = "UTF-8", "windows-1252", "ISO-8859-1"
# Characters that windows-1252 has where ISO-8859-1 has control codes.
_CODES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_FROM = "".join(chr(b) for b in _CODES)
_TO = bytes(_CODES).decode("cp1252")


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, block, size and id (rising within a block) of every line."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("id"),
    )


def decoded(value: Column, encoding: Column) -> Column:
    """Text of a line as read (bytes taken for UTF-8) under its file's encoding."""
    raw = value.cast("binary")
    latin = F.decode(raw, LATIN)
    return F.when(encoding == UTF8, value).when(encoding == WINDOWS, F.translate(latin, _FROM, _TO)).otherwise(latin)


def _separators(value: Column) -> Column:
    """How often each candidate separator stands outside quotes."""
    bare = F.regexp_replace(F.regexp_replace(value, '"[^"]*"', ""), '"[^"]*$', "")
    return F.array(*[F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in K.DELIMITERS])


def _tallied(lines: DataFrame) -> DataFrame:
    value, raw = F.col("value"), F.col("value").cast("binary")
    at = (F.col("block"), F.col("id"))
    wrong = ~F.is_valid_utf8(value)
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    keyed = lines.select(
        "file", "size", "block", "id", raw.alias("raw"), _separators(value).alias("counts"), quotes.alias("quotes"),
        wrong.alias("wrong"), F.when(wrong, F.hex(raw).rlike("^(?:..)*?[89].")).otherwise(False).alias("printed"),
        (F.length(F.trim(value)) > 0).alias("filled"),
    )
    place = F.struct(*at, F.col("raw"), F.col("counts"))
    return keyed.groupBy("file", "size", "counts").agg(
        F.count("*").alias("lines"), F.count_if("filled").alias("filled"),
        F.count_if("wrong").alias("wrong"), F.count_if("printed").alias("printed"),
        F.sum("quotes").alias("quotes"), F.count_if(F.col("quotes") % 2 == 1).alias("odd"),
        F.min(F.when(F.col("filled"), place)).alias("head"),
        F.max(F.struct(*at, F.substring("raw", -4, 4).alias("tail"))).alias("last"),
    )


def _chosen(tallied: DataFrame) -> DataFrame:
    """file, separator, position: the candidate that cuts the most lines of the file alike, and
    at least half of them; several fields before few, then the order of the candidates."""
    candidates = tallied.select("file", "filled", F.posexplode("counts").alias("position", "n"))
    alike = candidates.groupBy("file", "position", "n").agg(F.sum("filled").alias("alike"))
    whole = tallied.groupBy("file").agg(F.sum("filled").alias("whole"))
    fit = alike.filter("n > 0").join(whole, "file").filter("2 * alike >= whole")
    best = F.max(F.struct("alike", "n", (-F.col("position")).alias("order"))).alias("best")
    return fit.groupBy("file").agg(best).select("file", (-F.col("best.order")).alias("position"))


def dialects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row per file that is not empty.

    path, length, format, encoding, separator, opening (first character that is no space),
    header (bytes of the first line that is not blank), fields and most_fields (of the header,
    and of the widest line), long_rows, odd_lines (with an open quote), quotes and lines (not blank).
    """
    tallied = materialised(_tallied(text_lines(spark, path)), "dialects")
    files = tallied.groupBy("file", "size").agg(
        F.min("head").alias("head"), F.max("last").alias("last"), F.sum("wrong").alias("wrong"),
        F.sum("printed").alias("printed"), F.sum("quotes").alias("quotes"), F.sum("odd").alias("odd_lines"),
        F.sum("filled").alias("lines"),
    )
    comma = K.DELIMITERS.index(",")
    d = files.join(_chosen(tallied), "file", "left").withColumn("position", F.coalesce("position", F.lit(comma)))
    fields = F.get("head.counts", F.col("position"))
    d = d.withColumn("fields", fields + 1)
    wide = tallied.join(d.select("file", "position", "fields"), "file").withColumn("n", F.get("counts", F.col("position")) + 1)
    wide = wide.groupBy("file").agg(
        F.max("n").alias("most_fields"), F.sum(F.when(F.col("n") > F.col("fields"), F.col("lines")).otherwise(0)).alias("long_rows")
    )
    encoding = F.when(F.col("wrong") == 0, UTF8).when(F.col("printed") > 0, WINDOWS).otherwise(LATIN)
    opening = F.substring(F.ltrim(F.decode("head.raw", LATIN)), 1, 1)
    magic = F.lit(bytes(K.PARQUET_MAGIC))
    signed = (F.substring("head.raw", 1, 4) == magic) & (F.col("last.tail") == magic)
    kind = F.when(signed, "parquet").when(opening.isin("{", "["), "json")
    return d.join(wide, "file").select(
        F.col("file").alias("path"), F.col("size").alias("length"), kind.alias("format"), encoding.alias("encoding"),
        F.element_at(F.array(*[F.lit(s) for s in K.DELIMITERS]), F.col("position") + 1).alias("separator"),
        opening.alias("opening"), F.col("head.raw").alias("header"), "fields", "most_fields", "long_rows",
        "odd_lines", "quotes", "lines",
    )


def formats(spark: SparkSession, path: str) -> DataFrame:
    """path and format of every file that is not empty; null where neither is known.

    Parquet is told by its footers: a read of no columns opens nothing else of a file, whatever
    its size. The text of other files is then looked at; a Parquet file without rows is so
    small that it is told there, by its first and last bytes.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", "true")
    name = F.col("_metadata.file_path").alias("path")
    bare = reader().option("ignoreCorruptFiles", "true").schema(T.StructType([])).parquet(path)
    signed = materialised(bare.select(name).groupBy("path").count().select("path"), "footers")
    files = reader().format("binaryFile").load(path).filter("length > 0").select(name)
    rest = materialised(files.join(signed, "path", "left_anti"), "other-files")
    found = signed.withColumn("format", F.lit("parquet"))
    if not rest.limit(1).count():
        return found
    some = signed.limit(1).count() > 0
    # Names of files, as Spark's own listing holds them.
    paths = [unquote(r["path"]) for r in rest.collect()] if some else path
    return found.unionByName(dialects(spark, paths).select("path", "format"))


def line_numbers(lines: DataFrame) -> DataFrame:
    """The lines with `line_number` in their file, from 1. Ids rise by one within a block, so
    only a row per block is ordered, not the lines."""
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("block")) - F.col("_n")
    blocks = blocks.withColumn("_before", before)
    return lines.join(blocks, ["file", "block"]).withColumn(
        "line_number", F.col("_before") + F.col("id") - F.col("_first") + 1
    ).drop("_first", "_n", "_before")
