"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwise.llm.common import stored


def _star(links: DataFrame) -> DataFrame:
    """(node, neighbour, least): each node's neighbours and the smallest of them and itself."""
    least = links.groupBy("node").agg(F.least("node", F.min("neighbour")).alias("least"))
    return links.join(least, "node")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches. Loops and nulls are ignored.

    Every step is a join and a partial aggregate, so a node with very many links isn't gathered anywhere.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("neighbour")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")))
        large = _star(both).where("neighbour > node").select(F.col("neighbour").alias("node"), F.col("least").alias("neighbour"))
        large = stored(large.where("node <> neighbour").distinct())
        small = _star(large).select(F.explode(F.array(F.col("neighbour"), F.col("node"))).alias("node"),
                                    F.col("least").alias("neighbour"))
        edges = stored(small.where("node <> neighbour").distinct())
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "neighbour"))).first()
        if seen == before:
            roots = edges.select(F.col("neighbour").alias("node")).distinct()
            return edges.select("node", F.col("neighbour").alias("component")).union(
                roots.select("node", F.col("node").alias("component")))
        before = seen
