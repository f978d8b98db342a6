"""Ordered computations over whole tables without a single task: ranges, and what they pass to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.plans.scratch import materialize, pieces

RANGE_BYTES = 16 << 20
#: At most so many ranges; one row of each meets in one task.
MOST_RANGES = 20_000


def dealt(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``part``: rows dealt into ranges of ascending ``order``, equal values always into one. Written
    to the shared folder, as ranges are drawn from a sample and have to stay."""
    count = pieces(df, RANGE_BYTES, most=MOST_RANGES)
    return materialize(df.repartitionByRange(count, order).withColumn("part", F.spark_partition_id()), "ranges")


def join_parts(df: DataFrame, sums: DataFrame, names: list[str], after: bool = False) -> DataFrame:
    """``df`` with what the ranges before (or after) each row's range add up to. Of ``sums`` (part, names) sums are
    added from the first range on, and minima taken from the last one on."""
    if after:
        over = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
        cumulated = [F.min(n).over(over).alias(n) for n in names]
    else:
        over = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        cumulated = [F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in names]
    return df.join(F.broadcast(sums.select("part", *cumulated)), "part")  # a row for each range


def with_previous(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the value of the row before in ascending ``order`` (unique), over the whole table."""
    parts = dealt(df, order)
    last = parts.groupBy("part").agg(F.max_by(value, order).alias("_last"))
    last = last.select("part", F.lag("_last").over(W.orderBy("part")).alias("_last"))  # a row for each range
    inside = F.lag(value).over(W.partitionBy("part").orderBy(order))
    first = F.row_number().over(W.partitionBy("part").orderBy(order)) == 1
    return parts.join(F.broadcast(last), "part").withColumn(name, F.when(first, F.col("_last")).otherwise(inside)).drop("part", "_last")
