"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainforge.plans.scratch import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step. Every node hands its neighbours to the smallest of them; the large step does
    so for larger neighbours, the small step for the node itself and its smaller ones."""
    if large:
        seen = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Self loops register their node; rows with a null end are ignored. Each round writes its edges to the
    shared scratch folder, so lineage stays short and a lost executor costs one round. A hub's neighbours
    are spread by the next star step, so no group is gathered: both steps are joins and min-aggregates."""
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = ends.select(F.col("u").alias("node")).unionAll(ends.select("v")).distinct()
    now = materialize(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        step = materialize(_stars(_stars(now, True), False), "cc")
        discard(now)
        now = step
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    root = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("root", "node").alias("component"))
