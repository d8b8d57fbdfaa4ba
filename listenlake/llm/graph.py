"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the smallest node it reaches.

    Every label points at its smallest neighbour, pointers are followed to their ends, and the graph
    of labels is built anew without inner edges.  Each round is stored; a node with very many edges
    only meets as a minimum.  No edges give no rows.
    """
    links = cut_lineage(edges.select("a", "b").filter("a <> b").distinct())
    labels = cut_lineage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("root")))
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut_lineage(roots.join(up, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
            if roots.filter("moved").isEmpty():
                break
        end = roots.select(F.col("node").alias("label"), F.col("root"))
        labels = cut_lineage(labels.join(end, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = cut_lineage(links.join(a, "a").join(b, "b").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct())
    return labels
