"""Connected components of an edge table, as DataFrame rounds with a written table between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the smallest node reachable.

    Every round each node takes the smallest label among itself and its neighbours, then the label of that label,
    so labels travel along paths in doubling steps. A node with many neighbours is reduced before the shuffle.
    """
    both = edges.where(F.col("a") != F.col("b")).select("a", "b")
    both = staged(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", "root", F.least("root", "m").alias("r1"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("r2"))
        step = step.join(up, F.col("r1") == F.col("up")).select("node", "root", F.least("r1", "r2").alias("next"))
        done = staged(step, "labels")
        labels = done.select("node", F.col("next").alias("root"))
        if done.where(F.col("root") != F.col("next")).isEmpty():
            return labels
