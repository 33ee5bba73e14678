"""Co-clustering by information loss (ITCC) and by squared residue (MSSR I and II), in batch updates.

Distances to all clusters come from block sums over the label-joined cells and the clusters' sizes, with
absent cells as zeros: sum (a - mu)^2 = sum a^2 - 2 sum a mu + sum mu^2. Only non-empty
clusters are offered; a row moves only to a strictly nearer cluster, the first of equal ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from ..session import cut
from .bregman import initial_labels, labelled


class Schedule(Enum):
    ALTERNATE = "rows, then columns under the new row labels"
    SIMULTANEOUS = "rows and columns both under the old labels"
    REPEATED = "rows until nothing improves, then columns"


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    cols: DataFrame
    objectives: list[float]


def block_sums(m: CoordMatrix, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(g, h, s): the condensed matrix."""
    return labelled(m, rows, cols).groupBy("g", "h").agg(F.sum("value").alias("s"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """Clusters renamed 0, 1, ... in the order of their names, empty ones gone."""
    from pyspark.sql import Window

    names = labels.select("cluster").distinct().withColumn("__new", F.row_number().over(Window.orderBy("cluster")) - 1)  # one row a cluster
    return labels.join(names, "cluster").select("id", F.col("__new").cast("int").alias("cluster"))


# Information loss


def joint(m: CoordMatrix) -> CoordMatrix:
    """The matrix divided by the sum of its cells."""
    total = m.cells.agg(F.sum("value")).first()[0] or 1.0
    return m.scale(1.0 / total)


def information_loss(p: CoordMatrix, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """I(X;Y) - I(X^;Y^) in bits of a joint distribution."""

    def information(cells: DataFrame, a: str, b: str, v: str) -> DataFrame:
        x, y = cells.groupBy(a).agg(F.sum(v).alias("__x")), cells.groupBy(b).agg(F.sum(v).alias("__y"))
        return cells.filter(F.col(v) > 0).join(x, a).join(y, b).agg(F.sum(F.col(v) * F.log2(F.col(v) / (F.col("__x") * F.col("__y")))).alias("i"))

    full, coarse = information(p.cells, "row", "col", "value"), information(block_sums(p, rows, cols), "g", "h", "s")
    return full.crossJoin(coarse.withColumnRenamed("i", "j")).select((F.col("i") - F.col("j")).alias("loss"))  # one row each


def _best(cost: DataFrame, labels: DataFrame) -> DataFrame:
    """``cost``: (id, g, d). The nearest cluster; the old one stays unless another is strictly nearer."""
    old = labels.select("id", F.col("cluster").alias("__old"))
    d = F.round("d", 9)
    ranked = cost.join(old, "id").groupBy("id", "__old").agg(F.min(F.struct(d.alias("d"), (F.col("g") != F.col("__old")).alias("moves"), F.col("g").alias("g"))).alias("b"))
    return labels.join(ranked.select("id", "b.g"), "id", "left").select("id", F.coalesce("g", "cluster").cast("int").alias("cluster"))


def itcc_rows(p: CoordMatrix, rows: DataFrame, cols: DataFrame, alpha: float = 0.0) -> DataFrame:
    """Each row to the cluster whose prototype q(y|x^) = q(y^|x^) p(y|y^) is nearest in KL; ``alpha`` spreads that share evenly over the columns."""
    z = labelled(p, rows, cols)
    px = p.sums("row").select(F.col("id").alias("row"), F.col("total").alias("px"))
    # Terms that depend on the cluster only through q(y^|x^) are summed by column cluster.
    by_h = z.groupBy("row", "h").agg(F.sum("value").alias("v"))
    blocks = z.groupBy("g", "h").agg(F.sum("value").alias("s"))
    sizes = blocks.groupBy("g").agg(F.sum("s").alias("pg"))
    n_h = cols.groupBy(F.col("cluster").alias("h")).agg(F.count("*").alias("n"))
    grid = sizes.crossJoin(F.broadcast(n_h)).join(blocks, ["g", "h"], "left")  # clusters by clusters
    q = ((F.coalesce("s", F.lit(0.0)) / F.col("pg")) + alpha * F.col("n") / float(p.n_cols)) / (1 + alpha)
    score = grid.select("g", "h", F.when(q > 0, -F.log(q)).otherwise(1e30).alias("cost"))
    cost = by_h.join(px, "row").join(score, "h").groupBy(F.col("row").alias("id"), "g").agg(F.sum(F.col("v") / F.col("px") * F.col("cost")).alias("d"))
    return _best(cost, rows)


def itcc(m: CoordMatrix, k_rows: int, k_cols: int, rounds: int = 20, schedule: Schedule = Schedule.ALTERNATE, alpha: float = 0.1, threshold: float = 1e-3, rows: DataFrame | None = None, cols: DataFrame | None = None) -> Result:
    """Batch updates until the loss falls by less than ``threshold`` of the matrix's information; smoothing fades by half each round."""
    p = joint(m)
    p = CoordMatrix(cut(p.cells), m.n_rows, m.n_cols)
    whole = information_loss(p, *(p.cells.sparkSession.range(n).select("id", F.lit(0).alias("cluster")) for n in (m.n_rows, m.n_cols))).first()[0]
    step = lambda q, r, c, a: itcc_rows(q, r, c, a)
    return _loop(p, k_rows, k_cols, rounds, schedule, step, information_loss, threshold * whole, alpha, rows, cols)


# Squared residue


def residue(m: CoordMatrix, rows: DataFrame, cols: DataFrame, kind: int = 1) -> DataFrame:
    """Kind 1: sum of (a - block mean)^2. Kind 2: of (a - row mean - column mean + block mean)^2. Absent cells count as zeros."""
    z = labelled(m, rows, cols)
    nr, nc = rows.groupBy(F.col("cluster").alias("g")).agg(F.count("*").alias("nr")), cols.groupBy(F.col("cluster").alias("h")).agg(F.count("*").alias("nc"))
    sq = z.agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
    block = z.groupBy("g", "h").agg(F.sum("value").alias("s")).join(nr, "g").join(nc, "h").agg(F.sum(F.col("s") * F.col("s") / (F.col("nr") * F.col("nc"))).alias("b"))
    if kind == 1:
        return sq.crossJoin(block).select((F.col("sq") - F.col("b")).alias("residue"))  # one row each
    row = z.groupBy("row", "h").agg(F.sum("value").alias("s")).join(nc, "h").agg(F.sum(F.col("s") * F.col("s") / F.col("nc")).alias("r"))
    col = z.groupBy("col", "g").agg(F.sum("value").alias("s")).join(nr, "g").agg(F.sum(F.col("s") * F.col("s") / F.col("nr")).alias("c"))
    return sq.crossJoin(block).crossJoin(row).crossJoin(col).select((F.col("sq") - F.col("r") - F.col("c") + F.col("b")).alias("residue"))  # one row each


def mssr_costs(m: CoordMatrix, rows: DataFrame, cols: DataFrame, kind: int = 1) -> DataFrame:
    """(id, g, q, dot) of each row and non-empty cluster: up to a number of the row's own its squared residue there is q - 2 dot, and dot is linear in the row."""
    z = labelled(m, rows, cols)
    nr, nc = rows.groupBy(F.col("cluster").alias("g")).agg(F.count("*").alias("nr")), cols.groupBy(F.col("cluster").alias("h")).agg(F.count("*").alias("nc"))
    if kind == 1:
        mean = z.groupBy("g", "h").agg(F.sum("value").alias("s")).join(nr, "g").join(nc, "h").select("g", "h", (F.col("s") / (F.col("nr") * F.col("nc"))).alias("mu"), "nc")
        fixed = mean.groupBy("g").agg(F.sum(F.col("mu") * F.col("mu") * F.col("nc")).alias("q"))
        by_h = z.groupBy(F.col("row").alias("id"), "h").agg(F.sum("value").alias("v"))
        dots = by_h.join(mean, "h").groupBy("id", "g").agg(F.sum(F.col("v") * F.col("mu")).alias("dot"))
    else:  # both sides lose their means by column cluster first
        centre = z.groupBy("g", "col", "h").agg(F.sum("value").alias("s")).join(nr, "g").select("g", "col", "h", (F.col("s") / F.col("nr")).alias("mu"))
        block = z.groupBy("g", "h").agg(F.sum("value").alias("s")).join(nr, "g").join(nc, "h").select("g", "h", (F.col("s") / (F.col("nr") * F.col("nc"))).alias("mb"), "nc")
        fixed = centre.groupBy("g").agg(F.sum(F.col("mu") * F.col("mu")).alias("q1")).join(block.groupBy("g").agg(F.sum(F.col("mb") * F.col("mb") * F.col("nc")).alias("q2")), "g").select("g", (F.col("q1") - F.col("q2")).alias("q"))
        by_h = z.groupBy(F.col("row").alias("id"), "h").agg(F.sum("value").alias("v"))
        back = by_h.join(block, "h").groupBy("id", "g").agg(F.sum(F.col("v") * F.col("mb")).alias("back"))
        dots = m.cells.join(centre.select("g", "col", "mu"), "col").groupBy(F.col("row").alias("id"), "g").agg(F.sum(F.col("value") * F.col("mu")).alias("dot"))
        dots = back.join(dots, ["id", "g"], "left").select("id", "g", (F.coalesce("dot", F.lit(0.0)) - F.col("back")).alias("dot"))
    offered = rows.select("id").crossJoin(F.broadcast(fixed))  # one row a cluster
    return offered.join(dots, ["id", "g"], "left").select("id", "g", "q", F.coalesce("dot", F.lit(0.0)).alias("dot"))


def mssr_rows(m: CoordMatrix, rows: DataFrame, cols: DataFrame, kind: int = 1) -> DataFrame:
    """Each row to the cluster with the least squared residue."""
    return _best(mssr_costs(m, rows, cols, kind).select("id", "g", (F.col("q") - 2 * F.col("dot")).alias("d")), rows)


def mssr(m: CoordMatrix, k_rows: int, k_cols: int, kind: int = 1, rounds: int = 20, schedule: Schedule = Schedule.ALTERNATE, threshold: float = 1e-3, rows: DataFrame | None = None, cols: DataFrame | None = None) -> Result:
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    square = m.cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    step = lambda q, r, c, a: mssr_rows(q, r, c, kind)
    return _loop(m, k_rows, k_cols, rounds, schedule, step, lambda q, r, c: residue(q, r, c, kind), threshold * square, 0.0, rows, cols)


def _loop(m: CoordMatrix, k_rows: int, k_cols: int, rounds: int, schedule: Schedule, step, objective, least: float, alpha: float, rows: DataFrame | None, cols: DataFrame | None) -> Result:
    spark, t = m.cells.sparkSession, m.transpose()
    rows = cut(rows if rows is not None else initial_labels(spark.range(m.n_rows), k_rows))
    cols = cut(cols if cols is not None else initial_labels(spark.range(m.n_cols), k_cols))
    history = [objective(m, rows, cols).first()[0]]
    for _ in range(rounds):
        if schedule is Schedule.REPEATED:
            for axis in ("row", "col"):
                inner = history[-1]
                while True:
                    new = cut(step(m, rows, cols, alpha) if axis == "row" else step(t, cols, rows, alpha))
                    now = objective(m, *((new, cols) if axis == "row" else (rows, new))).first()[0]
                    if inner - now <= least:
                        break
                    rows, cols, inner = (new, cols, now) if axis == "row" else (rows, new, now)
        else:
            new = cut(step(m, rows, cols, alpha))
            cols = cut(step(t, cols, rows if schedule is Schedule.SIMULTANEOUS else new, alpha))
            rows = new
        history.append(objective(m, rows, cols).first()[0])
        alpha /= 2
        if history[-2] - history[-1] <= least:
            break
    return Result(rows, cols, history)


def farthest_start(p: CoordMatrix, k: int, alpha: float = 0.1) -> DataFrame:
    """(id, cluster): ``k`` rows far from each other, then every row with the nearest of them.

    The first is farthest from the mean of all rows, each further one has the largest summed distance to those before; distances are
    KL to the row's distribution, of which ``alpha`` is spread evenly. The driver gets one row number a step; the chosen rows stay in a table."""
    spark, n = p.cells.sparkSession, float(p.n_cols)
    total = p.sums("row").select(F.col("id").alias("row"), F.col("total").alias("__t"))
    shares = cut(p.cells.filter("value > 0").join(total, "row").select("row", "col", (F.col("value") / F.col("__t")).alias("v")))
    floor = alpha / n / (1 + alpha)

    def distances(proto: DataFrame, what: int) -> DataFrame:
        """(id, d) of each row to a prototype (col, q), smoothed; up to the row's own entropy, which all prototypes share."""
        cost = shares.join(proto, "col", "left").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("v") * -F.log(F.coalesce(F.col("q"), F.lit(0.0)) / (1 + alpha) + floor)).alias("d"), F.sum(F.col("v") * F.log("v")).alias("e"))
        return cost.select("id", (F.col("d") + F.col("e")).alias("d"), F.lit(what).alias("cluster"))

    mean = p.cells.groupBy("col").agg(F.sum("value").alias("q"))
    whole = p.cells.agg(F.sum("value")).first()[0] or 1.0
    first = distances(mean.select("col", (F.col("q") / whole).alias("q")), 0).orderBy(F.desc(F.round("d", 9)), "id").first()
    if first is None:
        return initial_labels(spark.range(p.n_rows), k)
    chosen, far = [first["id"]], None
    while True:
        own = cut(distances(shares.filter(F.col("row") == chosen[-1]).select("col", F.col("v").alias("q")), len(chosen) - 1))
        far = own if far is None else far.unionByName(own)
        if len(chosen) == k:
            break
        nxt = far.filter(~F.col("id").isin(chosen)).groupBy("id").agg(F.sum("d").alias("d")).orderBy(F.desc(F.round("d", 9)), "id").first()
        if nxt is None:
            break
        chosen.append(nxt["id"])
    near = far.groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "cluster")).alias("b"))
    return spark.range(p.n_rows).join(near, "id", "left").select("id", F.coalesce("b.cluster", F.lit(0)).cast("int").alias("cluster"))


def blocks_report(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """One row for each side's cluster: side, cluster, size."""
    side = lambda x, name: cluster_sizes(x).select(F.lit(name).alias("side"), "cluster", "n")
    return side(rows, "row").unionByName(side(cols, "col"))
