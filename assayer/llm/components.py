"""Connected components of a table of links, by alternating large-star and small-star steps. Nothing is gathered by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.storage import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """`id` and `root`, the smallest id of its component, for every id that stands in `links` (a, b), but the roots themselves.

    Each step gives every node a smaller neighbour through an aggregation with partial sums and a join, so a node with
    many links is no task's burden. Links of a node to itself and repeated links do no harm; empty links give an empty table.
    """
    rows = 2 * links.count()  # no step makes more
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges, "edges", rows)
    while True:
        # Large star: all larger neighbours of a node are linked to its smallest neighbour.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = scratch.keep(small.where("u <> v").distinct(), "edges", rows)
        scratch.drop(edges)
        edges = new
        # Done when every node has one link and no root has any: only stars are left.
        count, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if count == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
