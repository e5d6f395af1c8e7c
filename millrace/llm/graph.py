"""Connected components of a graph of hashed nodes, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b); nodes of a component share a label.

    Each round sends a node to the least of itself and its neighbours and
    contracts the edges. Nodes are hashes, so their order is random and the
    rounds are logarithmic in the number of nodes. A node with many edges is
    reduced to a minimum before anything is shuffled.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "graph-edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label")), "graph-labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = stored(both.groupBy(F.col("a").alias("label")).agg(F.least(F.col("label"), F.min("b")).alias("to")), "graph-to")
        past = edges, labels
        labels = stored(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "graph-labels")
        left = edges.join(to.select(F.col("label").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("label").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "graph-edges")
        for x in (*past, to):  # nothing reads the round before any more
            dropped(x)
    return labels
