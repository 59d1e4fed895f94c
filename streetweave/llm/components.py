"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetweave.llm.shared import discard, land


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (or the node)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    tied = both.where("v > u").join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are tied to the least of them. Edges have u > v."""
    least = _least(edges)
    tied = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (u, v) is connected with. A node of
    no edge has no row. Self-links and links given twice or both ways do no harm.

    Each round is landed, so no lineage builds up, and the one before it removed; the graph stays in the cluster, and the driver sees
    a count and a checksum, by which it tells that a round has changed nothing."""
    now = land(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(try_cast(xxhash64(u, v) >> 24 as decimal(38, 0)))")).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        after = land(_small_star(_large_star(now)), name)
        discard(now)
        now = after
