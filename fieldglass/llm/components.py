"""Connected components of a graph given as pairs of 64-bit ids, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b); a component's name is its smallest node.

    Each round gives every node the smallest label among its neighbours and then that label's own label, so the
    distance covered doubles. Labels are written to the shared folder each round. Sums per node are combined
    before the shuffle, and the joins are sort-merge joins that the engine splits at hot nodes.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        told = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("further"))
        after = staged(told.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("further", "now")).alias("component")), "labels")
        if after.filter(F.col("was") != F.col("component")).isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
