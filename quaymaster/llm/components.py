"""Connected components of a link table, by repeated contraction towards smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import some, staged

#: Edges, about, of which one file is written.
FILE_EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """node and label for every node of ``edges`` (a long, b long); equal labels are one component.

    In each round every vertex joins its smallest neighbour, if that is smaller, and edges are
    rewritten.  Vertices that keep edges are then local minima, at most half of them, so the rounds
    grow with the logarithm of the largest component.  Nothing is collected.  Loops and repeated
    edges are harmless; no edges give no rows.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", some(edges.sparkSession))
    files = max(1, edges.count() // FILE_EDGES)
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("m")).select("vertex", F.least("vertex", "m").alias("parent")), "parents", files)
        up_a = parents.select(F.col("vertex").alias("a"), F.col("parent").alias("pa"))
        up_b = parents.select(F.col("vertex").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(up_a, "a").join(up_b, "b").where("pa <> pb")
        edges = staged(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges", files)
        labels = labels.join(parents.withColumnRenamed("vertex", "label"), "label", "left")
        labels = staged(labels.select("node", F.coalesce("parent", "label").alias("label")), "labels", files)
    return labels
