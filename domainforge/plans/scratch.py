"""Shared scratch tables: lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"
#: Bytes a core where the optimizer has no estimate.
UNKNOWN = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in ``spark.checkpoint.dir``; only a
    session on one machine without that setting (as in tests) gets a temporary folder."""
    found = spark.conf.get(DIR_KEY, None) or spark.sparkContext.getConf().get(DIR_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{DIR_KEY} has to name a folder that all executors share")
        found = getattr(scratch_dir, "_own", None) or tempfile.mkdtemp(prefix="scratch-")
        scratch_dir._own = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def size_hint(df: DataFrame) -> int:
    """The optimizer's estimate of the plan's bytes. Only sizes partitions; results never depend on it.

    A plan on rows without statistics (made from an RDD or a list) counts as ``UNKNOWN`` a core."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else df.sparkSession.sparkContext.defaultParallelism * UNKNOWN


def pieces(df: DataFrame, each: int, least: int = 8, most: int = 200_000) -> int:
    """How many buckets of about ``each`` bytes the input of ``df`` makes."""
    return max(least, min(most, -(-size_hint(df) // each)))
