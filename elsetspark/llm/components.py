"""Connected components by alternating large-star and small-star rounds.

Links live in tables in the shared folder; each round is two joins with map-side minima, and what
stays is one edge from every node to the smallest node of its component. Rounds stop when the
edges no longer change; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long, in any direction). Returns node, root for every node that has a link."""
    flat = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = flat.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("x")).first()
        if mark == (now["n"], now["x"]):
            return flat.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (now["n"], now["x"])
        both = flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima in a table of their own: then both sides of the join are exchanged and a hub can be split.
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large)
        scratch.drop(least)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, flat = flat, scratch.write(small.distinct())
        scratch.drop(last, large)
