"""Session settings that the wide expressions here depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM never compiles a method above 8000 bytes to machine code. A fused stage
# beyond that would run interpreted, several times slower; with this limit Spark
# leaves such a stage unfused and its expressions are split into small methods.
HUGE_METHOD_LIMIT = "8000"

# Pieces of a file scan for each core, as Spark's one leaves half of the cores idle while the
# last of few long tasks end. Files of some MB are not cut.
PIECES = 4
_PIECES_KEY = "spark.sql.files.minPartitionNum"


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT)
    if spark.conf.get(_PIECES_KEY, None) is None:
        spark.conf.set(_PIECES_KEY, str(PIECES * spark.sparkContext.defaultParallelism))
    return spark
