"""Connected components by minimum labels, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestar.llm.scratch import dropped, stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); the component is its smallest node.

    Each round every node takes the smallest label around it, then the label
    of its label; rounds grow with the logarithm of the longest chain.  Every
    round is written to the shared folder, so losing an executor loses a round
    at most; the table of the round before is deleted.  Links with a null end
    are ignored, as are links of a node with itself and repeated ones.
    """
    pairs = links.filter("a <> b").select("a", "b")
    edges = stored(pairs.union(pairs.select("b", "a")).distinct(), f"{name}-edges")
    held = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), name)
    while True:
        labels = held.select("node", "component")
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("component").alias("root"))
        new = stored(nearer.join(roots, "near").select("node", "old", F.least("near", "root").alias("component")), name)
        changed = new.filter("component <> old").limit(1).count()
        dropped(held)
        if not changed:
            dropped(edges)
            return new.select("node", "component")
        held = new
