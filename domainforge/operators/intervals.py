"""Interval algebra on rows: islands, gaps, clipping, intersection, and interval joins with an equal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap(s1: Column | str, e1: Column | str, s2: Column | str, e2: Column | str) -> Column:
    """min(ends) - max(starts); negative is the gap between the intervals."""
    return F.least(e1, e2) - F.greatest(s1, s2)


def islands(df: DataFrame, keys: list[str], distance: int = 0, touching: bool = True, alone: bool = False) -> DataFrame:
    """Unions of intervals that overlap, touch, or lie at most ``distance`` apart (at less than ``distance``,
    if not ``touching``). One sort by the keys serves both windows. Rows without a start or an end come last;
    those without a start join the last union, or stand by themselves if ``alone``."""
    order = W.partitionBy(*keys).orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    last = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("s") - last
    fresh = F.when(last.isNull() | (F.lit(alone) & F.col("s").isNull()) | (apart > distance if touching else apart >= distance), 1).otherwise(0)
    marked = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def gaps(df: DataFrame, lengths: DataFrame, key: str = "nid", least: int = 0) -> DataFrame:
    """Parts of each sequence outside of all intervals, longer than ``least``: head, middle and tail. A sequence
    without intervals gives its whole range."""
    order = W.partitionBy(key).orderBy("s", "e")
    before = F.coalesce(F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = df.select(key, "s", "e").withColumn("_b", before).select(key, F.col("_b").alias("s"), F.col("s").alias("e"))
    tails = lengths.join(df.groupBy(key).agg(F.max("e").alias("_m")), key, "left").select(key, F.coalesce("_m", F.lit(0)).alias("s"), F.col("length").alias("e"))
    return inner.unionByName(tails).where(F.col("e") - F.col("s") > least)


def outermost(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct intervals that no other one contains."""
    order = W.partitionBy(*keys).orderBy("s", F.desc("e"))
    return df.select(*keys, "s", "e").distinct().withColumn("_m", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))).where("_m is null or e > _m").drop("_m")


def clip(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where((F.col("e") > first) & (F.col("s") < last)).withColumn("s", F.greatest("s", F.lit(first))).withColumn("e", F.least("e", F.lit(last)))


def intersections(a: DataFrame, b: DataFrame, key: str = "nid") -> DataFrame:
    """Pairwise non-empty intersections by key."""
    right = b.select(key, F.col("s").alias("_s"), F.col("e").alias("_e"))
    return a.join(right, key).where(overlap("s", "e", "_s", "_e") > 0).select(key, F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e"))


def subtract(a: DataFrame, b: DataFrame, key: str = "nid") -> DataFrame:
    """Parts of each interval of ``a`` outside of all of ``b``; equal rows of ``a`` count once."""
    own = a.select(key, "s", "e").distinct()
    cover = islands(b.select(key, "s", "e"), [key]).select(key, F.col("s").alias("_s"), F.col("e").alias("_e"))
    hit = own.join(cover, key, "left").where("_s is null or (_s < e and _e > s)")
    touched = hit.where("_s is not null")
    order = W.partitionBy(key, "s", "e").orderBy("_s")
    left = touched.select(key, "s", "e", F.coalesce(F.lag("_e").over(order), F.col("s")).alias("_from"), F.col("_s").alias("_to"))
    right = touched.groupBy(key, "s", "e").agg(F.max("_e").alias("_from")).withColumn("_to", F.col("e"))
    free = own.join(touched.select(key, "s", "e").distinct(), [key, "s", "e"], "left_anti")
    parts = left.unionByName(right).where("_from < _to").select(key, F.col("_from").alias("s"), F.col("_to").alias("e"))
    return parts.unionByName(free)


def chain(links: DataFrame, limit: int = 30) -> DataFrame:
    """Links of a pair, in order, that follow each other within ``limit`` on both sides become one.

    Each link meets the chain merged so far, so this is a fold over the sorted links of a pair."""
    item = "struct<qs:int,qe:int,ss:int,se:int,evalue:double>"
    pair = links.groupBy("query_nid", "sbjct_nid").agg(F.array_sort(F.collect_list(F.struct("qs", "qe", "ss", "se", "evalue"))).alias("links"))
    merged = f"""aggregate(links, cast(array() as array<{item}>), (acc, x) ->
        if(size(acc) > 0 and x.qs - element_at(acc, -1).qe between 1 and {limit} and x.ss - element_at(acc, -1).se between 1 and {limit},
           cast(concat(slice(acc, 1, size(acc) - 1), array(named_struct('qs', element_at(acc, -1).qs, 'qe', greatest(element_at(acc, -1).qe, x.qe),
                'ss', element_at(acc, -1).ss, 'se', greatest(element_at(acc, -1).se, x.se), 'evalue', least(element_at(acc, -1).evalue, x.evalue)))) as array<{item}>),
           cast(concat(acc, array(x)) as array<{item}>)))"""
    return pair.select("query_nid", "sbjct_nid", F.explode(F.expr(merged)).alias("m")).select("query_nid", "sbjct_nid", "m.*")


def best_overlap(refs: DataFrame, tests: DataFrame, key: str = "nid", least: int = 0) -> DataFrame:
    """For each reference interval the test interval of largest intersection over union; ties by start and end."""
    t = tests.select(key, F.col("s").alias("ts"), F.col("e").alias("te")).distinct()
    common = overlap("s", "e", "ts", "te")
    share = common / (F.greatest("e", "te") - F.least("s", "ts"))
    found = refs.join(t, key).where(common > least)
    return found.groupBy(key, "s", "e", "family").agg(F.max_by(F.struct("ts", "te", common.alias("common"), F.round(share, 6).alias("share")), F.struct(share, -F.col("ts"), -F.col("te"))).alias("m")).select(key, "s", "e", "family", "m.*")
