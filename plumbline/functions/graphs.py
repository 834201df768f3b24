"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected ``edges`` (a, b).

    Every round each node takes its smallest neighbour as parent, parents are followed four steps, and the edges
    between the parents go on; the number of nodes falls by half at least, so the rounds are logarithmic. Nothing but
    whether edges remain reaches the driver.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["a"]
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        parents = parents.select("v", F.least("v", "p").alias("p"))
        for _ in range(2):
            up = parents.select(F.col("v").alias("_v"), F.col("p").alias("_up"))
            parents = cut(parents.join(up, F.col("p") == F.col("_v")).select("v", F.col("_up").alias("p")))
        up = parents.select(F.col("v").alias("_v"), F.col("p").alias("_up"))
        if labels is None:
            labels = parents.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(up, F.col("root") == F.col("_v"), "left").select(
                "node", F.coalesce("_up", "root").alias("root")
            )
        down = parents.select(F.col("v").alias("_w"), F.col("p").alias("_down"))
        mapped = edges.join(up, F.col("a") == F.col("_v")).join(down, F.col("b") == F.col("_w"))
        mapped = mapped.select(F.col("_up").alias("a"), F.col("_down").alias("b"))
        # A parent that is not yet its own parent keeps its link upwards.
        climbing = parents.join(up, F.col("p") == F.col("_v")).select(F.col("p").alias("a"), F.col("_up").alias("b"))
        edges = cut(
            mapped.unionByName(climbing).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        labels = cut(labels)
    if labels is None:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return labels
