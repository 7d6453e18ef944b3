"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step keeps the components and moves every node nearer to the smallest of
its component. A node's neighbours are reduced by a grouped minimum, never
gathered in one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: ``root`` is the smallest node reachable. Loops name lone nodes."""
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()
    now = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        # Large star: each greater neighbour goes to the least of a node and its neighbours.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its lesser neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("x"), "m")
            .where("x > m")
            .select(F.col("x").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        now = written(small, "edges")
        # Done when every node has one edge, to a node that has none itself.
        ends, nodes_with = now.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if ends == nodes_with and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
