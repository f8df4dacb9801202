"""The most frequent values of columns, exactly, whatever the values' length and number.

A mergeable sketch per column names candidates, and one more count of those few is exact. The
sketch's error bound then proves that no other value can be among the first, or shows for which
columns it cannot; only those are counted in full.

Long values go by a key: their digest and first characters, of fixed size. Texts themselves
are fetched at the end, for the values that are reported or tie with one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limpid import constants as K
from limpid.operators.aggregate import small_table
from limpid.operators.counts import LONG_VALUE, unpivoted
from limpid.operators.sampling import first_n_per_group
from limpid.operators.schema import text_columns
from limpid.storage import materialised

# Values of a column that a sketch tracks, as it is broadcast for the exact count.
TRACKED = 2000
# Long values whose texts may be fetched by a broadcast of their keys.
FETCHED = 100_000


def value_key(v: Column) -> Column:
    """The value, or beyond `LONG_VALUE` characters its digest and first characters."""
    return F.when(F.length(v) > LONG_VALUE, F.concat(F.sha2(v, 256), F.left(v, F.lit(LONG_VALUE)))).otherwise(v)


def _is_long(key: Column) -> Column:
    return F.length(key) > LONG_VALUE


def _head(key: Column) -> Column:
    """What of the value orders it; the whole of a short one."""
    return F.when(_is_long(key), F.substring(key, 65, LONG_VALUE)).otherwise(key)


def missed_at_most(n: int, tracked: int = TRACKED) -> float:
    """Most occurrences that a value can have which a sketch of `n` values does not name.

    The sketch keeps the next power of two above tracked / 0.75 counters; an estimate is off by
    3.5 / counters of all values, and a value is named if that cannot have made it up.
    """
    counters = 1 << max(3, (-(-4 * tracked // 3) - 1).bit_length())
    return 2 * 3.5 / counters * n


def sketched_counts(df: DataFrame, columns: Sequence[str], tracked: int = TRACKED) -> tuple[DataFrame, dict[str, int]]:
    """(column, key, n) exactly, of the values the sketches name; and each column's present values."""
    keyed = unpivoted(df, columns).filter("value is not null").select("column", value_key(F.col("value")).alias("key"))
    sketches = keyed.groupBy("column").agg(
        F.count("*").alias("present"), F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("sketch")
    )
    named = materialised(
        sketches.select("column", "present", F.expr(f"approx_top_k_estimate(sketch, {tracked})").alias("items"))
        .select("column", "present", F.inline_outer("items")).select("column", "present", F.col("item").alias("key")),
        "named",
    )
    present = {r["column"]: r["present"] for r in named.select("column", "present").distinct().collect()}
    few = F.broadcast(named.filter("key is not null").select("column", "key"))  # `tracked` short keys a column
    exact = keyed.join(few, ["column", "key"], "left_semi").groupBy("column", "key").agg(F.count("*").alias("n"))
    return materialised(exact, "exact"), present


def top_counts(df: DataFrame, columns: Sequence[str], n: int, tracked: int = TRACKED) -> DataFrame:
    """(column, key, n): all values of each column that can be among its `n` most frequent."""
    exact, present = sketched_counts(df, columns, tracked)
    least = first_n_per_group(exact, ["column"], [F.desc("n"), F.asc("key")], n, spread=False)
    least = {r["column"]: (r["least"], r["rows"]) for r in least.groupBy("column").agg(F.min("n").alias("least"), F.count("*").alias("rows")).collect()}
    sums = {r["column"]: r["n"] for r in exact.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    proven = {
        c for c, p in present.items()
        if sums.get(c) == p or (c in least and least[c][1] == n and least[c][0] > missed_at_most(p, tracked))
    }
    rest = [c for c in columns if c in present and c not in proven]
    found = exact.filter(F.col("column").isin(*proven)) if proven else exact.limit(0)
    if rest:
        keyed = unpivoted(df, rest).filter("value is not null").select("column", value_key(F.col("value")).alias("key"))
        found = found.unionByName(keyed.groupBy("column", "key").agg(F.count("*").alias("n")))
    return found


def top_values_of(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = K.TOP_CATEGORIES, tracked: int = TRACKED
) -> DataFrame:
    """(column, value, n): the `n` most frequent values of each column; ties by value."""
    columns = text_columns(df) if columns is None else list(columns)
    if not columns or n < 1:
        return small_table(df.sparkSession, [], "column string, value string, n long")
    key = F.col("key")
    counted = materialised(top_counts(df, columns, n, tracked).withColumn("head", _head(key)), "value-counts")
    # The last of the first n by what is known of a value; everything up to it may be reported.
    order = [F.desc("n"), F.asc("head"), F.asc("key")]
    last = first_n_per_group(counted, ["column"], order, n).groupBy("column").agg(
        F.min("n").alias("_n"), F.max_by("head", F.struct(-F.col("n"), "head")).alias("_head")
    )
    ahead = (F.col("n") > F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("head") <= F.col("_head")))
    near = materialised(counted.join(F.broadcast(last), "column").filter(ahead).select("column", "key", "n"), "contenders")
    short = near.filter(~_is_long(key)).select("column", key.alias("value"), "n")
    long = near.filter(_is_long(key))
    n_long = long.count()
    if n_long:
        cells = unpivoted(df, columns).filter(F.length("value") > LONG_VALUE).withColumn("key", value_key(F.col("value")))
        wanted = F.broadcast(long) if n_long <= FETCHED else long
        texts = cells.join(wanted, ["column", "key"]).select("column", "value", "n")
        # Equal values are equal texts: whatever their number, a task sends each it may need once.
        short = short.unionByName(texts.dropDuplicates(["column", "value"]))
    return first_n_per_group(short, ["column"], [F.desc("n"), F.asc("value")], n).select("column", "value", "n")
