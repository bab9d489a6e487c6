"""Connected components by label exchange and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsift.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of an edge.

    Edges are pairs of longs in either order; loops and repeats do no harm, a null end drops
    the edge.  Each round takes the smallest label among a node and its neighbours, then the
    label of that label, and replaces each link by one between labels, so a chain of n nodes
    needs about log n rounds and links inside a finished component vanish.  Labels and links
    are written tables, so joins on a node with very many links start from plain shuffles that
    adaptive execution splits.
    """
    spark = edges.sparkSession
    links = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                    .where("a is not null and b is not null and a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        # The smallest neighbour of each label, itself included.
        lowest = written(links.select(F.col("b").alias("node"), F.col("a").alias("low"))
                         .union(links.select(F.col("a").alias("node"), F.col("a").alias("low")))
                         .groupBy("node").agg(F.min("low").alias("low")), "lowest")
        jump = lowest.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        roots = written(lowest.join(jump, "low", "left")
                        .select("node", F.coalesce("lower", "low").alias("root")), "roots")
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            labels = written(labels.join(roots.withColumnRenamed("node", "component"), "component", "left")
                             .select("node", F.coalesce("root", "component").alias("component")), "labels")
        from_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        from_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        links = written(links.join(from_a, "a").join(from_b, "b")
                        .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
                        .where("a <> b").distinct(), "links")
    if labels is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return labels
