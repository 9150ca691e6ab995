"""Connected components by alternating stars: each round points nodes at smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: greater neighbours move to the least one. Small star: the others do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge at most that leads to a smaller node, and that node has none."""
    roles = edges.select("u", F.lit(1).alias("down")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down")).distinct()
    )
    odd = roles.groupBy("u").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return odd.where("down > 1 or (down = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v); the component is its least node.

    Each round is written to the shared folder; edges that are stars already need none. Null ends and
    loops are no edges. Nodes without an edge do not appear. A hot node's neighbours are combined before
    the shuffle and split in the joins.
    """
    edges = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = materialise(edges.where("u <> v and v is not null").distinct(), "edges")
    for _ in range(max_rounds):
        if _stars(edges):
            break
        edges = materialise(_star(_star(edges, large=True), large=False), "edges")
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    roots = roots.select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
