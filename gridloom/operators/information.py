"""Mutual information of variables and of joint tables, and trees from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from .graph import spanning_tree


def pair_counts(observations: DataFrame) -> DataFrame:
    """(a, b, s, t, n): how often node a is in state s while node b > a is in state t. ``observations``: a row each, ``x`` the states by node; equal rows count each.

    Equal rows are counted before their nodes are paired, so what is exchanged are counts of distinct rows and of pairs."""
    rows = observations.groupBy("x").agg(F.count("*").alias("n"))
    pairs = rows.select("n", "x", F.posexplode("x").alias("a", "s")).select("n", "a", "s", F.posexplode("x").alias("b", "t")).filter("a < b")
    return pairs.groupBy("a", "b", "s", "t").agg(F.sum("n").alias("n"))


def mutual_information(observations: DataFrame) -> DataFrame:
    """(a, b, mi) in nats of each pair of nodes."""
    c = pair_counts(observations)
    left = c.groupBy("a", "b", "s").agg(F.sum("n").alias("ns"))
    right = c.groupBy("a", "b", "t").agg(F.sum("n").alias("nt"))
    total = c.groupBy("a", "b").agg(F.sum("n").alias("total"))
    j = c.join(left, ["a", "b", "s"]).join(right, ["a", "b", "t"]).join(total, ["a", "b"])
    return j.groupBy("a", "b").agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("ns") * F.col("nt")))).alias("mi"))


def co_occurrence(observations: DataFrame) -> DataFrame:
    """(a, b, p): share of observations where both binary nodes are 1, a <= b."""
    rows = observations.groupBy("x").agg(F.count("*").alias("n"))
    on = rows.select("n", "x", F.posexplode("x").alias("a", "s")).filter("s = 1").select("n", "a", F.posexplode("x").alias("b", "t")).filter("t = 1 AND a <= b")
    total = observations.agg(F.count("*").alias("total"))
    return on.groupBy("a", "b").agg(F.sum("n").alias("n")).crossJoin(total).select("a", "b", (F.col("n") / F.col("total")).alias("p"))  # total: one row


def chow_liu(observations: DataFrame, nodes: int) -> DataFrame:
    """Edges of the tree of largest mutual information."""
    mi = mutual_information(observations).select(F.col("a").cast("bigint").alias("row"), F.col("b").cast("bigint").alias("col"), F.col("mi").alias("value"))
    return spanning_tree(CoordMatrix(mi, nodes, nodes), largest=True)


def hub_edges(observations: DataFrame, hub: int, k: int) -> DataFrame:
    """The ``k`` nodes of largest mutual information with ``hub``."""
    return mutual_information(observations).filter((F.col("a") == hub) | (F.col("b") == hub)).orderBy(F.desc("mi"), "a", "b").limit(k)


def table_information(m: CoordMatrix) -> DataFrame:
    """Mutual information in bits of a joint table, whose cells are first divided by their sum."""
    total = m.cells.agg(F.sum("value").alias("total"))
    px, py = m.sums("row").select(F.col("id").alias("row"), F.col("total").alias("x")), m.sums("col").select(F.col("id").alias("col"), F.col("total").alias("y"))
    j = m.cells.filter("value > 0").join(px, "row").join(py, "col").crossJoin(total)  # one row
    return j.agg(F.sum(F.col("value") / F.col("total") * F.log2(F.col("value") * F.col("total") / (F.col("x") * F.col("y")))).alias("mi"))
