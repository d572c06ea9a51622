"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimill.llm.storage import kept, shuffled


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, shuffled anew so that a hot node can be split in the join."""
    return edges.groupBy("a").agg(F.min("b").alias("low")).repartition(F.xxhash64("a"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b bigint) but the roots, the smallest of their component.

    Each round lets every node tie its larger neighbours to its smallest, then its smaller ones;
    rounds grow with the logarithm of the longest path. The links of a round are kept in the shared
    folder, the driver sees their number and checksum only.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.where("b > a")
            .join(shuffled(_lowest(both)), "a")
            .select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
            .distinct()
        )
        low = _lowest(large)
        small = large.join(shuffled(low), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = kept(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
