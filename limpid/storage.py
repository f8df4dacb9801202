"""Shared scratch space and materialised tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="limpid-")


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where `spark.checkpoint.dir` is unset and all runs in one process, as in a local
    test, is a temporary folder made; elsewhere that is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/limpid/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write the table once and read it back: lineage ends, columns stay prunable."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialised_alone(df: DataFrame, name: str) -> DataFrame:
    """`materialised`, and the shuffle files of the job that writes go when it ends, not when the driver
    next collects its garbage. For tables of which no other job shares a shuffle."""
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE_KEY, None)
    conf.set(_RELEASE_KEY, "true")
    try:
        return materialised(df, name)
    finally:
        conf.unset(_RELEASE_KEY) if before is None else conf.set(_RELEASE_KEY, before)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        scratch = f"{scratch_dir(spark)}/limpid/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(scratch).toUri().getPath()):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one task, of a table as it is read.
TASK_ROWS = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that comes in far fewer pieces than there are cores, or in
    pieces of many rows: a well-packed file of some MB can hold millions, and a task would grow
    with it. Other inputs pass unchanged, so nothing is shuffled there.

    For tables as they are read, whose rows are counted from their footers.
    """
    cores, pieces = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores, -(-df.count() // TASK_ROWS))
    return df.repartition(wanted) if pieces <= wanted // 2 else df
