"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import store


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (id, label), the smallest id that each linked id reaches.

    Large-star and small-star steps in turn until the set of edges stays the same: each step groups
    edges by one end, and a hub's edges are joined to its minimum, never gathered.
    """
    edges = store.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[:]) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = store.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = store.keep(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
