"""Operator 10: sources mixed to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from limpid.llm.columns import WORD, documents, quoted, text_of
from limpid.storage import materialised

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Row numbers by code point, null last, without one task for all sources.

    Ranges of names are numbered apart; the number of rows in the ranges before is added.
    The ranges are as many as shuffle partitions, so their counts may be broadcast.
    """
    keyed = sources.withColumns({"_null": F.col("source").isNull(), "_bytes": F.encode(F.coalesce("source", F.lit("")), "UTF-8")})
    ranged = materialised(
        keyed.repartitionByRange("_null", "_bytes").withColumn("_range", F.spark_partition_id()), "sources"
    )
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).collect()  # a row per partition
    before, total = {}, 0
    for r in sorted(counts, key=lambda r: r["_range"]):
        before[r["_range"]], total = total, total + r["_n"]
    if not before:
        return ranged.withColumn("_rank", F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_null", "_bytes"))
    return ranged.withColumn("_rank", (offset + inside - 1).cast("long"))


def source_targets(sized: DataFrame, share=SHARE, weights=WEIGHTS, limit=LIMIT) -> DataFrame:
    """A row per source: source, source_size, weight, target.

    The wanted words are `share` times all sizes, dealt by weight. A source stops at `limit`
    times its own size; what it would have had above that is dealt again to the others by
    weight, until none is above. Each round is one aggregate over the sources, and a source
    that stopped stays stopped, so the rounds end. A source of size 0 gets 0.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialised(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    cap = limit * F.col("source_size")
    unit, stopped = 0.0, None
    while True:
        above = F.lit(False) if stopped is None else cap <= F.col("weight") * unit
        x = table.agg(
            F.sum("source_size").alias("all"), F.count_if(above).alias("n"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if x["n"] == stopped or not x["open"]:
            break
        stopped = x["n"]
        unit = (share * x["all"] - x["held"]) / x["open"]
    return table.withColumn("target", F.least(cap, F.col("weight") * unit))


def _uniform(key: Column, seed: str) -> Column:
    """In [0, 1), from 48 bits of an MD5 of the key: the same in every run."""
    digits = F.substring(F.md5(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")), "UTF-8")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**48))


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and copies: floor(rate), and one more where a draw seeded by
    the id falls below the fraction. `docs` needs doc_id and source. The targets are joined
    on the source; a source with a third of all rows is split by Spark's skew join, or moves
    nothing where the table of sources is small enough to broadcast."""
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    joined = docs.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (_uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int"))


def op10_mixing(spark, folder):
    """All documents: null text has size 0; a row that occurs twice is taken twice."""
    sized = materialised(documents(spark, folder).select("doc_id", "source", size_of().alias("size")), "sizes")
    mixed = with_copies(sized, source_targets(sized))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """The mixed documents themselves: each row `copies` times, with `copy` from 0.

    A column of `docs` named like one that this adds is replaced by it.
    """
    columns = [c for c in columns or docs.columns if c not in ("copy", "target", "source_size", "copies")]
    seed = options.pop("seed", SEED)
    sized = materialised(docs.select("source", size_of().alias("size")), "sizes")
    mixed = with_copies(docs.select(*quoted(columns)), source_targets(sized, **options), seed)
    return mixed.filter("copies > 0").select(
        *quoted(columns), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )


_LEVELS = 64  # rounds of the SQL twin; each stops one source or more, or changes nothing
OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, '')))) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
u AS (
  SELECT 1 AS k, {SHARE}::DOUBLE * sum(source_size) / sum(w) AS unit FROM s
  UNION ALL
  SELECT k + 1, (SELECT ({SHARE}::DOUBLE * sum(source_size)
                  - sum(CASE WHEN {LIMIT} * source_size <= w * unit THEN {LIMIT} * source_size ELSE 0 END))
                 / sum(CASE WHEN {LIMIT} * source_size <= w * unit THEN 0 ELSE w END) FROM s)
  FROM u WHERE k < {_LEVELS}),
t AS (
  SELECT source, source_size,
         least({LIMIT} * source_size, w * (SELECT unit FROM u WHERE k = {_LEVELS}))::DOUBLE AS target FROM s),
r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         list_reduce(list_transform(string_split(substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{SEED}'), 1, 12), ''),
                     lambda c: (instr('0123456789abcdef', c) - 1)::DOUBLE), lambda a, b: a * 16 + b) / {2**48}.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM r
"""
