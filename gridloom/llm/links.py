"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _mark(edges: DataFrame) -> tuple:
    """Number, sum and exclusive or of the edges' hashes: alike for the same edges, and for no others that may be met."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links``: pairs of longs. Returns fp and root (the smallest member) for every member of a link.

    Each step is a group by the node with a minimum, joined back, so a hub's neighbours are never
    gathered in one row; the tables between steps are written, so a lost executor costs one step."""
    edges = scratch(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch(large.filter("u <> v").distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = scratch(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        now = _mark(small)
        edges, same, before = small, now == before, now
        if same:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
