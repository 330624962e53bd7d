"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); the component is its smallest node.

    Each round hangs every node below its smallest neighbour, jumps along these pointers once and
    replaces the links' ends by what they hang below. Every node that is not the smallest of its
    surroundings is gone after a round, so the links shrink fast whatever the components' shape. Each
    round is written to the shared folder. Minimum is a combining aggregate, so a node with very many
    links costs its partition one row per task.
    """
    ends = lambda x: x.select(F.col("a").alias("u"), F.col("b").alias("v")).union(x.select("b", "a"))
    proper = materialise(links.select("a", "b").where("a <> b").distinct())
    nodes = materialise(ends(proper).groupBy("u").agg(F.min("v").alias("v"))
                        .select(F.col("u").alias("node"), F.least("u", "v").alias("component")))
    assigned, below = None, nodes
    while True:
        up = below.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        below = materialise(below.join(up, "component").select("node", F.col("higher").alias("component")))
        step = below.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        assigned = below if assigned is None else materialise(
            assigned.join(step, "component", "left").select("node", F.coalesce("higher", "component").alias("component")))
        a, b = (below.select(F.col("node").alias(x), F.col("component").alias(f"{x}_up")) for x in "ab")
        proper = materialise(proper.join(a, "a").join(b, "b").where("a_up <> b_up")
                             .select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct())
        if proper.isEmpty():
            return assigned
        below = materialise(ends(proper).groupBy("u").agg(F.min("v").alias("v"))
                            .select(F.col("u").alias("node"), F.least("u", "v").alias("component")))
