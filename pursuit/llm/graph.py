"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Each round points every node at its smallest neighbour, shortens the pointers twice and
    contracts the edges along them, so at least every node that is no local minimum goes.
    Edges from where a pointer ends to that node's own pointer keep components whole.
    Loops and repeated edges are harmless; no edges give no rows. Hubs are safe: a node's
    smallest neighbour is a partial aggregate, and the relabelling joins have one row a node
    on one side, which adaptive execution can split.
    """
    edges = _undirected(edges.select("a", "b"))
    edges = cut(edges, "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "hook")
        ends = _follow(_follow(step, step), step)
        ends = cut(ends, "ends")
        maps.append(ends)
        one, two = ends.toDF("a", "x"), ends.toDF("b", "y")
        moved = edges.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        rest = ends.select(F.col("to").alias("node")).distinct().join(step, "node").select(F.col("node").alias("a"), F.col("to").alias("b"))
        edges = cut(_undirected(moved.unionByName(rest)), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        out = _follow(out, later)
    return out.withColumnRenamed("to", "root")


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(at: DataFrame, step: DataFrame) -> DataFrame:
    """``at`` (node, to) with ``to`` moved along ``step``; ends that ``step`` lacks stay."""
    on = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return at.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
