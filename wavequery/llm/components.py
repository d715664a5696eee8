"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join with a table of one row per node and a deduplication; nothing gathers a
component in one place. The per-node minima are written out, so that both sides of each join are
plain exchanges and a hub with a large share of the edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _minima(e: DataFrame, name: str) -> DataFrame:
    return staged(e.groupBy("u").agg(F.min("v").alias("m")), name)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a, b. Returns node, root (the smallest node of its component) for
    every node on an edge to another node; rows with a null or with a = b say nothing and are ignored."""
    e = staged(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both, "large"), "u").where(F.col("v") > F.col("u"))
        large = staged(large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large-star")
        low = _minima(large, "small")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
