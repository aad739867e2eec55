"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmarrow.session import frozen


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b); root is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shrink
    by half. Every round is a written table; a hub is a skewed join side that Spark can split.
    """
    pairs = edges.where("a <> b")
    pairs = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    pairs = frozen(pairs.distinct(), "graph-edges")
    labels = frozen(pairs.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "graph-labels")
    while True:
        sent = pairs.join(labels, pairs.u == labels.node).groupBy(F.col("v").alias("to")).agg(F.min("root").alias("sent"))
        near = labels.join(sent, labels.node == F.col("to")).select("node", F.least("root", "sent").alias("near"), F.col("root").alias("was"))
        near = frozen(near, "graph-near")
        far = near.select(F.col("node").alias("via"), F.col("near").alias("far"))
        new = near.join(far, F.col("near") == F.col("via")).select("node", F.col("far").alias("root"), "was")
        new = frozen(new, "graph-labels")
        labels = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return labels
