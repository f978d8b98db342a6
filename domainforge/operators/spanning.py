"""Minimum spanning forest by Boruvka rounds, and shortest paths by a frontier."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainforge.operators.graph import components
from domainforge.plans.scratch import discard, materialize


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """The edges (a, b, weight) of the minimum spanning forest under the total order (weight, a, b).

    In every round each component takes its least outgoing edge; the order is total, so no cycle closes. Self
    loops are dropped, and of repeated edges the lightest counts."""
    base = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    base = materialize(base, "forest")
    chosen = None
    live = base.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb"))
    for _ in range(max_rounds):
        ends = live.select(F.col("ca").alias("c"), "a", "b", "weight").unionAll(live.select(F.col("cb").alias("c"), "a", "b", "weight"))
        least = ends.groupBy("c").agg(F.min(F.struct("weight", "a", "b")).alias("m")).select("m.*").distinct().select("a", "b", "weight")
        found = materialize(least if chosen is None else chosen.unionAll(least), "forest")
        if chosen is not None:
            discard(chosen)
        chosen = found
        label = components(chosen)
        x, y = (label.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in "ab")
        live = materialize(base.join(x, "a").join(y, "b").where("ca <> cb").select("a", "b", "weight", "ca", "cb"), "forest")
        if live.isEmpty():
            break
    else:
        raise RuntimeError("the forest is not complete after all rounds")
    return chosen


def distances(edges: DataFrame, source, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all nodes reachable from ``source`` by undirected edges (a, b)."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = frontier = edges.sparkSession.createDataFrame([(source, 0)], f"node {dict(edges.dtypes)['a']}, depth int")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = frontier.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = materialize(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "path")
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionAll(frontier), "path")
    return seen
