"""Bregman co-clustering of a weighted matrix: I-divergence or squared distance, six bases.

The approximation h of a cell keeps certain means of the data: of row clusters (g), column clusters
(h), blocks (gh), rows (r), columns (c), rows by column cluster (rh) and row clusters by column (gc). All
means come from sums over the label-joined cells. Only cells present carry weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from ..session import cut

#: Which means a basis keeps: as a product of quotients for I-divergence, as a signed sum for squares.
BASES: dict[int, tuple[tuple[str, ...], tuple[str, ...]]] = {
    1: (("g", "h"), ("all",)),
    2: (("gh",), ()),
    3: (("gh", "r"), ("g",)),
    4: (("gh", "c"), ("h",)),
    5: (("gh", "r", "c"), ("g", "h")),
    6: (("gc", "rh"), ("gh",)),
}
_KEYS = {"g": ["g"], "h": ["h"], "gh": ["g", "h"], "r": ["row"], "c": ["col"], "rh": ["row", "h"], "gc": ["g", "col"], "all": []}


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    cols: DataFrame
    objectives: list[float]


def initial_labels(df_ids: DataFrame, k: int) -> DataFrame:
    """(id, cluster): ids dealt round."""
    return df_ids.select("id", F.pmod("id", F.lit(k)).cast("int").alias("cluster"))


def labelled(m: CoordMatrix, rows: DataFrame, cols: DataFrame) -> DataFrame:
    g, h = rows.select(F.col("id").alias("row"), F.col("cluster").alias("g")), cols.select(F.col("id").alias("col"), F.col("cluster").alias("h"))
    return m.cells.join(g, "row").join(h, "col")


_COLUMNS = ("g", "h", "row", "col")


def _set(name: str) -> int:
    """The grouping id of a mean: a bit for each column that it does not group by."""
    return sum(1 << (3 - k) for k, c in enumerate(_COLUMNS) if c not in _KEYS[name])


def all_means(z: DataFrame, names: tuple[str, ...] = tuple(_KEYS)) -> DataFrame:
    """(g, h, row, col, set, m): the means of labelled cells by all groupings named, from one pass; columns not grouped by are null."""
    sets = [[F.col(c) for c in _KEYS[n]] for n in names]
    return z.groupingSets(sets, *[F.col(c) for c in _COLUMNS]).agg(F.avg("value").alias("m"), F.grouping_id().cast("int").alias("set"))


def with_means(z: DataFrame, names: tuple[str, ...] = tuple(_KEYS)) -> DataFrame:
    """``z`` with a column m_name for each mean. Those of a row come in one join, as a number and one by column cluster; so do those of a column."""
    means = cut(all_means(z, names))
    of = lambda name: means.filter(F.col("set") == _set(name))
    out = z
    for axis, own, other, by in (("row", "r", "rh", "h"), ("col", "c", "gc", "g")):
        wanted = [n for n in (own, other) if n in names]
        if wanted:
            each = means.filter(F.col("set").isin([_set(n) for n in wanted])).groupBy(axis).agg(
                F.max(F.when(F.col("set") == _set(own), F.col("m"))).alias(f"m_{own}"),
                F.map_from_entries(F.collect_list(F.when(F.col("set") == _set(other), F.struct(by, "m")))).alias("__by"),  # an entry a cluster
            )
            out = out.join(each, axis)
            out = out.withColumn(f"m_{other}", F.element_at("__by", F.col(by))) if other in names else out
            out = out.drop("__by", *([] if own in names else [f"m_{own}"]))
    for name in ("gh", "g", "h", "all"):
        if name in names:
            small = of(name).select(*_KEYS[name], F.col("m").alias(f"m_{name}"))
            out = out.join(small, _KEYS[name]) if _KEYS[name] else out.crossJoin(small)  # one row
    return out


def _fit(basis: int, divergence: str) -> Column:
    up, down = BASES[basis]
    fit: Column = F.lit(1.0 if divergence == "i" else 0.0)
    for name in up:
        fit = fit * F.col(f"m_{name}") if divergence == "i" else fit + F.col(f"m_{name}")
    for name in down:
        fit = fit / F.col(f"m_{name}") if divergence == "i" else fit - F.col(f"m_{name}")
    return fit


def approximation(z: DataFrame, basis: int, divergence: str) -> DataFrame:
    """``z``: labelled cells. Adds ``fit``, the basis' approximation of each cell."""
    up, down = BASES[basis]
    return with_means(z, (*up, *down)).withColumn("fit", _fit(basis, divergence))


def loss(divergence: str, value: Column, fit: Column) -> Column:
    if divergence == "i":
        return F.when(value > 0, value * F.log(value / fit)).otherwise(0.0) - value + fit
    return (value - fit) * (value - fit)


def objective(m: CoordMatrix, rows: DataFrame, cols: DataFrame, basis: int, divergence: str) -> DataFrame:
    fitted = approximation(cut(labelled(m, rows, cols)), basis, divergence)
    return fitted.agg(F.sum(loss(divergence, F.col("value"), F.col("fit"))).alias("objective"))


def objectives(m: CoordMatrix, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(basis, divergence, objective) of all bases under both divergences; the matrix is read once."""
    fitted = with_means(cut(labelled(m, rows, cols)))
    kinds = [(b, d) for b in BASES for d in ("i", "e")]
    sums = fitted.agg(*[F.sum(loss(d, F.col("value"), _fit(b, d))).alias(f"s{b}{d}") for b, d in kinds])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(b).alias("basis"), F.lit(d).alias("divergence"), F.col(f"s{b}{d}").alias("objective")) for b, d in kinds])).alias("o")).select("o.*")


def reassign(m: CoordMatrix, rows: DataFrame, cols: DataFrame, basis: int, divergence: str, k: int, axis: str = "row") -> DataFrame:
    """New (id, cluster) of one axis: each row takes the cluster under whose means its cells fit best, the first of equal ones.

    Each cell meets the ``k`` clusters of its own column (or column cluster), never all rows."""
    if axis == "col":
        return reassign(m.transpose(), cols, rows, {3: 4, 4: 3}.get(basis, basis), divergence, k)
    z = labelled(m, rows, cols)
    own = {"r": ["row"], "rh": ["row", "h"], "c": ["col"], "h": ["h"], "all": []}
    up, down = BASES[basis]
    base = z
    for name in [x for x in (*up, *down) if x in own]:
        means = z.groupBy(*own[name]).agg(F.avg("value").alias(f"m_{name}"))
        base = base.join(means, own[name]) if own[name] else base.crossJoin(means)  # one row
    offered = base.drop("g")
    varying = [x for x in (*up, *down) if x not in own]
    clusters = z.sparkSession.range(k).select(F.col("id").cast("int").alias("g"))
    offered = offered.crossJoin(F.broadcast(clusters))  # k rows
    whole = z.agg(F.avg("value").alias("m_whole"))
    offered = offered.crossJoin(whole)  # one row
    for name in varying:
        means = z.groupBy(*_KEYS[name]).agg(F.avg("value").alias(f"m_{name}"))
        offered = offered.join(means, _KEYS[name], "left").withColumn(f"m_{name}", F.coalesce(f"m_{name}", "m_whole"))
    fit: Column = F.lit(1.0 if divergence == "i" else 0.0)
    for name in up:
        fit = fit * F.col(f"m_{name}") if divergence == "i" else fit + F.col(f"m_{name}")
    for name in down:
        fit = fit / F.col(f"m_{name}") if divergence == "i" else fit - F.col(f"m_{name}")
    cost = offered.groupBy("row", "g").agg(F.round(F.sum(loss(divergence, F.col("value"), fit)), 9).alias("d"))
    best = cost.groupBy("row").agg(F.min(F.struct("d", "g")).alias("b")).select(F.col("row").alias("id"), F.col("b.g").alias("cluster"))
    return rows.select("id", F.col("cluster").alias("__old")).join(best, "id", "left").select("id", F.coalesce("cluster", "__old").alias("cluster"))


def cocluster(m: CoordMatrix, k_rows: int, k_cols: int, basis: int = 2, divergence: str = "i", rounds: int = 50, tolerance: float = 1e-5, rows: DataFrame | None = None, cols: DataFrame | None = None) -> Result:
    """Alternate row and column reassignment until the objective falls by no more than ``tolerance`` of itself."""
    spark = m.cells.sparkSession
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    rows = cut(rows if rows is not None else initial_labels(spark.range(m.n_rows), k_rows))
    cols = cut(cols if cols is not None else initial_labels(spark.range(m.n_cols), k_cols))
    history = [objective(m, rows, cols, basis, divergence).first()[0]]
    for _ in range(rounds):
        rows = cut(reassign(m, rows, cols, basis, divergence, k_rows))
        cols = cut(reassign(m, rows, cols, basis, divergence, k_cols, "col"))
        history.append(objective(m, rows, cols, basis, divergence).first()[0])
        if history[-2] - history[-1] <= abs(history[-2]) * tolerance:
            break
    return Result(rows, cols, history)


def hierarchical(m: CoordMatrix, levels: int, basis: int = 2, divergence: str = "i", rounds: int = 5) -> list[Result]:
    """Split every row and column cluster in two at each level; rows move only between the halves of their parent."""
    out, spark = [], m.cells.sparkSession
    rows, cols = spark.range(m.n_rows).select("id", F.lit(0).alias("cluster")), spark.range(m.n_cols).select("id", F.lit(0).alias("cluster"))
    for _ in range(levels):
        halves = lambda x: x.select("id", (F.col("cluster") * 2 + F.pmod("id", F.lit(2))).cast("int").alias("cluster"))
        parents_r, parents_c = rows, cols
        rows, cols = cut(halves(rows)), cut(halves(cols))
        history = []
        for _ in range(rounds):
            for axis in ("row", "col"):
                old, parents = (rows, parents_r) if axis == "row" else (cols, parents_c)
                k = 2 * (1 + (parents.agg(F.max("cluster")).first()[0] or 0))
                moved = reassign(m, rows, cols, basis, divergence, k, axis).withColumnRenamed("cluster", "__new")
                inside = F.floor(F.col("__new") / 2) == F.floor(F.col("cluster") / 2)
                new = cut(old.join(moved, "id").select("id", F.when(inside, F.col("__new")).otherwise(F.col("cluster")).cast("int").alias("cluster")))
                rows, cols = (new, cols) if axis == "row" else (rows, new)
            history.append(objective(m, rows, cols, basis, divergence).first()[0])
            if len(history) > 1 and history[-2] - history[-1] <= abs(history[-2]) * 1e-5:
                break
        out.append(Result(rows, cols, history))
    return out


def rmse(train: CoordMatrix, probe: CoordMatrix, rows: DataFrame, cols: DataFrame, basis: int) -> DataFrame:
    """Root mean squared error on ``probe`` of the squared-distance approximation learned from ``train``; unseen means count as the mean of all."""
    z, p = labelled(train, rows, cols), labelled(probe, rows, cols)
    whole = z.agg(F.avg("value").alias("m_whole"))
    p = p.crossJoin(whole)  # one row
    up, down = BASES[basis]
    fit: Column = F.lit(0.0)
    for name in (*up, *down):
        means = z.groupBy(*_KEYS[name]).agg(F.avg("value").alias(f"m_{name}"))
        p = p.join(means, _KEYS[name], "left") if _KEYS[name] else p.withColumn("m_all", F.col("m_whole"))
        own = F.coalesce(F.col(f"m_{name}"), F.col("m_whole"))
        fit = fit + own if name in up else fit - own
    return p.agg(F.sqrt(F.avg((F.col("value") - fit) * (F.col("value") - fit))).alias("rmse"))
