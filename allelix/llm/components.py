"""Connected components of a distributed edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b), both of one orderable type; component is the smallest node reachable.

    In each round every node joins the neighbour with the smallest hash, if that is below its own, and edges are drawn
    between what the nodes joined; the hash changes by round, so long chains shrink as fast as stars. Each step is
    written before the next reads it: lineage stays short, both sides of each join come from an exchange, and
    adaptive execution can split the rows of a hub. Loops and null nodes are dropped.
    """
    def no_loops(df: DataFrame) -> DataFrame:
        return df.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, labels, step = scratch.write(no_loops(edges), "edges"), None, 0
    while not left.isEmpty():
        step += 1
        rank = lambda c: F.xxhash64(F.lit(step), c)  # noqa: B023, E731
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        nearest = both.groupBy("node").agg(F.min(F.struct(rank(F.col("other")).alias("rank"), "other")).alias("best"))
        joined = scratch.write(nearest.select("node", F.when(F.col("best.rank") < rank(F.col("node")), F.col("best.other")).otherwise(F.col("node")).alias("parent")), "parents")
        ends = left.join(joined.select(F.col("node").alias("a"), F.col("parent").alias("a_parent")), "a")
        ends = scratch.write(ends.select("b", "a_parent"), "half contracted")
        ends = ends.join(joined.select(F.col("node").alias("b"), F.col("parent").alias("b_parent")), "b")
        left = scratch.write(no_loops(ends.select(F.col("a_parent").alias("a"), F.col("b_parent").alias("b"))), "edges")
        if labels is None:
            labels = joined.select("node", F.col("parent").alias("label"))
        else:
            moved = labels.join(joined.select(F.col("node").alias("label"), "parent"), "label", "left")
            labels = scratch.write(moved.select("node", F.coalesce("parent", "label").alias("label")), "labels")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    smallest = scratch.write(labels.groupBy("label").agg(F.min("node").alias("component")), "smallest")
    return labels.join(smallest, "label").select("node", "component")
