"""Connected components of a graph by alternating large-star and small-star steps, in tables.

Each step is a join and an aggregation over the edges; nothing goes to the driver but a count, and every round is written to
the shared folder. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges: a, b (longs, not null). Returns node, component (the smallest node reachable), for every node of an edge.

    Defined cases: loops and repeated edges have no effect but that their nodes count; no edges, no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    links = stored(links.where("a <> b"), "links")
    for _ in range(max_rounds):
        # Large star: every neighbour above a node moves to the node's smallest neighbour, itself included.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join may split the neighbours of a hub.
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every neighbour below a node, and the node, move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        # Done when every node hangs on a root: nothing that is linked below is itself a child.
        changed = after.join(after.select(F.col("a").alias("child")), F.col("b") == F.col("child"), "left_semi").limit(1).count()
        links = after
        if not changed:
            more = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
            if not more:
                break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
