"""Connected components of a link table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from givetide.llm.common import forget
from givetide.sources.warehouse import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node in ``links`` (a, b): root is the least node that can be reached.

    Each round hangs every node's larger neighbours on its least neighbour, then every node and its smaller
    neighbours on the least of those (large star, small star). The table never holds more rows than links and nodes,
    a node of many links is joined and pre-aggregated, never gathered, and the number of rounds grows with the
    logarithm of the largest component. Every round is settled, and what the round before left is deleted.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        done, edges = edges, settle(small.distinct())
        forget(done)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
