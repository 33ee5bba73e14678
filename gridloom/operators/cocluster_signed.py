"""Co-clusters of squared residue whose rows, or rows and columns, may be reversed.

A label is (id, cluster, sign); with sign -1 the row stands in its cluster with all values negated. Signs are carried through
block sums, centroids and distances by multiplying them into the cells: all sums are those of the signed matrix, and a
row's distance to a cluster with its sign turned follows from the same product, q + 2 dot instead of q - 2 dot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from ..session import cut
from . import cocluster
from .bregman import initial_labels

#: Distances are compared as shares of the matrix's sum of squares.
DIGITS = 9


@dataclass(frozen=True)
class SignedResult:
    rows: DataFrame  # id, cluster, sign
    cols: DataFrame
    objectives: list[float]


def signed_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """(id, cluster, sign) from labels that count from 1, negative for reversed ids."""
    return labels.select("id", (F.abs(label) - 1).cast("int").alias("cluster"), F.when(F.col(label) < 0, -1).otherwise(1).alias("sign"))


def unsigned_labels(labels: DataFrame) -> DataFrame:
    """(id, label): the other way round."""
    return labels.select("id", ((F.col("cluster") + 1) * F.col("sign")).cast("int").alias("label"))


def signed(m: CoordMatrix, rows: DataFrame, cols: DataFrame | None = None) -> CoordMatrix:
    """The matrix with reversed rows, and columns where these have signs, negated."""
    cells = m.cells
    for axis, labels in (("row", rows), ("col", cols)):
        if labels is not None and "sign" in labels.columns:
            cells = cells.join(labels.select(F.col("id").alias(axis), F.col("sign").alias("__s")), axis).withColumn("value", F.col("value") * F.col("__s")).drop("__s")
    return CoordMatrix(cells.select("row", "col", "value"), m.n_rows, m.n_cols)


def block_sums(m: CoordMatrix, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(g, h, s): the condensed signed matrix."""
    return cocluster.block_sums(signed(m, rows, cols), rows, cols)


def residue(m: CoordMatrix, rows: DataFrame, cols: DataFrame, kind: int = 1) -> DataFrame:
    """The squared residue of the signed matrix, kinds as in :func:`cocluster.residue`."""
    return cocluster.residue(signed(m, rows, cols), rows, cols, kind)


def reassigned(m: CoordMatrix, rows: DataFrame, cols: DataFrame, kind: int = 1) -> DataFrame:
    """(id, cluster, sign): each row with the cluster and sign of least squared residue; it stays unless another pair is strictly nearer, of equal ones
    the first cluster, then the sign it has."""
    s = signed(m, rows, cols)
    scale = s.cells.agg(F.greatest(F.sum(F.col("value") * F.col("value")), F.lit(1e-300)).alias("all"))
    old = rows.select("id", F.col("cluster").alias("old"), "sign")
    near = cocluster.mssr_costs(s, rows, cols, kind).join(old, "id").crossJoin(scale)  # one row
    offer = lambda d, turned: F.struct(F.round(d / F.col("all"), DIGITS).alias("d"), ((F.col("g") != F.col("old")) | F.lit(turned)).alias("goes"), F.col("g").alias("g"), F.lit(turned).alias("turned"))
    best = F.array_min(F.array(offer(F.col("q") - 2 * F.col("dot"), False), offer(F.col("q") + 2 * F.col("dot"), True)))
    best = near.groupBy("id").agg(F.min(best).alias("b"))
    new = rows.join(best, "id", "left")
    return new.select("id", F.coalesce("b.g", "cluster").cast("int").alias("cluster"), F.when(F.col("b.turned"), -F.col("sign")).otherwise(F.col("sign")).cast("int").alias("sign"))


def mssr_signed(m: CoordMatrix, k_rows: int, k_cols: int, kind: int = 1, rounds: int = 20, threshold: float = 1e-3, rows: DataFrame | None = None, cols: DataFrame | None = None, both: bool = False) -> SignedResult:
    """Batch updates of rows, then columns under the new row labels, until the residue falls by less than ``threshold`` of the sum of squares.

    Rows may be reversed, with ``both`` columns too. Without labels given all ids are dealt and none is reversed."""
    spark = m.cells.sparkSession
    m = CoordMatrix(cut(m.cells.select("row", "col", "value")), m.n_rows, m.n_cols)
    plain = lambda x: x if "sign" in x.columns else x.withColumn("sign", F.lit(1))
    rows = cut(plain(rows if rows is not None else initial_labels(spark.range(m.n_rows), k_rows)))
    cols = cols if cols is not None else initial_labels(spark.range(m.n_cols), k_cols)
    cols = cut(plain(cols) if both else cols.select("id", "cluster"))
    least = threshold * (m.cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
    history = [residue(m, rows, cols, kind).first()[0]]
    for _ in range(rounds):
        rows = cut(reassigned(m, rows, cols, kind))
        t = m.transpose()
        cols = cut(reassigned(t, cols, rows, kind) if both else cocluster.mssr_rows(signed(t, cols, rows), cols, rows, kind))
        history.append(residue(m, rows, cols, kind).first()[0])
        if history[-2] - history[-1] <= least:
            break
    return SignedResult(rows, cols, history)
