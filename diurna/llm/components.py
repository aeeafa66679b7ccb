"""Connected components of an edge table, by contraction, without a driver-side graph.

Every round hooks each component to the smallest component beside it, follows the hooks to
their ends, and contracts the edges; components at least halve, so rounds grow with
the logarithm of the largest one. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), "cc-edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("c"), F.least("a", "m").alias("p")), "cc-hooks")
        while True:      # follow the hooks: c -> p -> p's p
            up = hooks.select(F.col("c").alias("p"), F.col("p").alias("q"))
            hooks = written(hooks.join(up, "p").select("c", "q", (F.col("p") != F.col("q")).alias("moved"))
                            .withColumnRenamed("q", "p"), "cc-hooks")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.select("c", "p")
        labels = written(labels.join(hooks, F.col("component") == F.col("c"), "left").select(
            "node", F.coalesce("p", "component").alias("component")), "cc-labels")
        at = lambda e, k: e.join(hooks.select(F.col("c").alias(k), F.col("p").alias("_" + k)), k)
        edges = written(at(at(edges, "a"), "b").where("_a <> _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "cc-edges")
    return labels
