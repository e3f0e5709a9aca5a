"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import scratch


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it can reach) for the ends of all edges (a, b).

    Each round gives every node the smallest label around it, then follows labels to their own labels, until nothing
    changes. Labels are minima, which combine before the shuffle; nothing but the count of changes reaches the driver.
    """
    both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(around, labels.node == around.a).select("node", F.least("component", "m").alias("next"), F.col("component").alias("old"))
        lower = scratch(lower, "lower")
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("further"))
        new = scratch(lower.join(jump, lower.next == jump["at"]).select("node", F.least("next", "further").alias("component"), "old"), "labels")
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
