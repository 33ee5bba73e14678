"""Local search of co-clusterings by chains of single moves, on sums that are kept by deltas.

What a move changes is small: the sums and size of two clusters. ``Moves`` reads the cells once and keeps a row of sums by column cluster
for each row of the matrix; the driver has the sums of the clusters, as many numbers as there are blocks. A step is one pass
over those rows that exchanges nothing but each task's best move; the state then takes the moved row's sums from one cluster and adds them to another. For
residue II the products of rows with the clusters' column sums are kept as well: a move adds a table of
the moved row's products with others, from the cells of its columns only, and the steps after it read the union of these deltas.

The objective's change is exact: for residues from sums s of a cluster with n rows, the parts s^2 / n before and after; for the information
loss from x log2 x of the sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from ..session import cut
from .bregman import labelled

#: Changes are compared to this share of the objective's scale, so equal ones are told by id and cluster whatever the matrix's size.
DIGITS = 12


@dataclass
class _Cluster:
    n: int
    sums: list[float]  # by column cluster; for residues divided by the root of its size
    square: float = 0.0  # sum over columns of the squared column sums


def _plog(x: Column) -> Column:
    """x log2 x; 0, and what rounding leaves of it, is 0."""
    return F.when(x > 1e-15, x * F.log2(x)).otherwise(0.0)


def _plain(x: float) -> float:
    return x * math.log2(x) if x > 1e-15 else 0.0


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class Moves:
    """The state of a chain of row moves. ``kind``: 1 or 2, the residue; ``"itcc"``, the information loss of a joint distribution."""

    rows: DataFrame  # id, cluster, v (sums by column cluster), vv (sum of squares), dots (products with each cluster's column sums)
    clusters: list[_Cluster]
    kind: int | str
    cells: DataFrame
    scale: float
    made: list[Row] = field(default_factory=list)
    deltas: DataFrame | None = None  # id, old, new, p: what moves so far add to products

    @staticmethod
    def of(m: CoordMatrix, rows: DataFrame, cols: DataFrame, kind: int | str = 1) -> Moves:
        sizes = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        widths = {r["cluster"]: r["n"] for r in cols.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        k, l = 1 + max(sizes, default=-1), 1 + max(widths, default=-1)  # noqa: E741
        z = cut(labelled(m, rows, cols).select("row", "col", "value", "g", "h"))
        unit = [1.0 if kind == "itcc" else 1.0 / math.sqrt(widths.get(h, 1)) for h in range(l)]
        per = F.array(*map(F.lit, unit))
        by_h = z.groupBy(F.col("row").alias("id"), "h").agg((F.sum("value") * F.element_at(per, F.col("h") + 1)).alias("v"), F.sum(F.col("value") * F.col("value")).alias("vv"))
        sums = by_h.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"), F.sum("vv").alias("vv"))  # an entry a column cluster
        wide = F.transform(F.sequence(F.lit(0), F.lit(l - 1)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0.0))) if l else F.array().cast("array<double>")
        table = rows.select("id", "cluster").join(sums, "id", "left").select("id", "cluster", wide.alias("v"), F.coalesce("vv", F.lit(0.0)).alias("vv"))
        table = table.withColumn("v", F.coalesce("v", F.array_repeat(F.lit(0.0), l)))
        blocks = {(r["g"], r["h"]): r["s"] for r in z.groupBy("g", "h").agg(F.sum("value").alias("s")).collect()}  # one row a block
        clusters = [_Cluster(sizes.get(g, 0), [blocks.get((g, h), 0.0) * unit[h] for h in range(l)]) for g in range(k)]
        square = z.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 1.0
        if kind == 2:
            centre = z.groupBy("g", "col").agg(F.sum("value").alias("s"))
            for r in centre.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("q")).collect():
                clusters[r["g"]].square = r["q"]
            dots = z.select("row", "col", "value").join(centre, "col").groupBy(F.col("row").alias("id"), "g").agg(F.sum(F.col("value") * F.col("s")).alias("d"))
            dots = dots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("g", "d"))).alias("m"))  # an entry a cluster
            all_dots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: F.coalesce(F.element_at("m", g), F.lit(0.0)))
            table = table.join(dots, "id", "left").select("id", "cluster", "v", "vv", F.coalesce(all_dots, F.array_repeat(F.lit(0.0), k)).alias("dots"))
        else:
            table = table.withColumn("dots", F.array().cast("array<double>"))
        scale = 1.0 if kind == "itcc" else square
        return Moves(cut(table), clusters, kind, z.select("row", "col", "value"), scale)

    def _state(self) -> DataFrame:
        """One row: all clusters' sizes and sums."""
        spark = self.rows.sparkSession
        rows = [(g, c.n, c.sums, c.square) for g, c in enumerate(self.clusters)]
        return spark.createDataFrame([(rows,)], "clusters array<struct<g:int,n:int,s:array<double>,q:double>>")

    def _gain(self, c: Column, v: Column, vv: Column, dot: Column, sign: int) -> Column:
        """The objective's change as a row joins (1) or leaves (-1) the cluster ``c``."""
        n, s = c["n"], c["s"]
        if self.kind == "itcc":
            change = F.aggregate(F.zip_with(s, v, lambda a, b: _plog(a) - _plog(a + sign * b)), F.lit(0.0), lambda x, y: x + y)
            total, own = (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) for x in (s, v))
            return change - (_plog(total) - _plog(total + sign * own))

        def part(square: Column, product: Column, own: Column) -> Column:
            before = F.when(n > 0, square / n).otherwise(0.0)
            after = F.when(n + sign > 0, (square + 2 * sign * product + own) / (n + sign)).otherwise(0.0)
            return before - after

        blocks = part(_dot(s, s), _dot(s, v), _dot(v, v))
        return blocks if self.kind == 1 else part(c["q"], dot, vv) - blocks

    def best(self, fixed: list[int] | None = None) -> Row | None:
        """The move that lowers the objective most, not of a row moved before: id, cluster, old, change, and the row's sums. A cluster's last row stays; empty clusters are not offered."""
        table = self.rows.filter(~F.col("id").isin([-1, *(fixed or []), *[r["id"] for r in self.made]]))
        if self.deltas is not None:
            more = self.deltas.groupBy("id").agg(F.collect_list(F.struct("old", "new", "p")).alias("more"))  # an entry a move
            added = F.transform("dots", lambda d, g: d + F.aggregate(F.coalesce("more", F.array().cast("array<struct<old:int,new:int,p:double>>")), F.lit(0.0), lambda s, x: s + F.when(x["new"] == g, x["p"]).when(x["old"] == g, -x["p"]).otherwise(0.0)))
            table = table.join(more, "id", "left").withColumn("dots", added).drop("more")
        offers = table.crossJoin(F.broadcast(self._state())).withColumn("own", F.element_at("clusters", F.col("cluster") + 1)).filter("own.n > 1")  # one row
        dot = lambda c: F.element_at("dots", c["g"] + 1) if self.kind == 2 else F.lit(0.0)
        leave = self._gain(F.col("own"), F.col("v"), F.col("vv"), dot(F.col("own")), -1)
        offers = offers.withColumn("leave", leave).select("*", F.explode("clusters").alias("to")).filter("to.n > 0 AND to.g <> cluster")
        change = (F.col("leave") + self._gain(F.col("to"), F.col("v"), F.col("vv"), dot(F.col("to")), 1)).alias("change")
        offers = offers.select("id", F.col("to.g").alias("cluster"), F.col("cluster").alias("old"), change, "v", "vv", "dots")
        order = F.struct(F.round(F.col("change") / self.scale, DIGITS), "id", "cluster")
        found = offers.agg(F.min_by(F.struct(*offers.columns), order).alias("b")).first()["b"]
        return found

    def make(self, move: Row) -> None:
        """Take the row's sums from its cluster and add them to the other one."""
        for g, sign in ((move["old"], -1), (move["cluster"], 1)):
            c = self.clusters[g]
            c.n += sign
            c.sums = [a + sign * b for a, b in zip(c.sums, move["v"], strict=True)]
            if self.kind == 2:
                c.square += 2 * sign * move["dots"][g] + move["vv"]
        if self.kind == 2:
            own = self.cells.filter(F.col("row") == move["id"]).select("col", F.col("value").alias("__own"))
            products = self.cells.join(own, "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("__own")).alias("p"))
            new = cut(products.select("id", F.lit(move["old"]).cast("int").alias("old"), F.lit(move["cluster"]).cast("int").alias("new"), "p"))
            self.deltas = new if self.deltas is None else self.deltas.unionByName(new)
        self.made.append(move)


def best_row_move(m: CoordMatrix, rows: DataFrame, cols: DataFrame, fixed: list[int] | None = None, kind: int | str = 1) -> DataFrame:
    """The single row move that lowers the objective most: (id, cluster, change). Rows in ``fixed`` do not move."""
    found = Moves.of(m, rows, cols, kind).best(fixed)
    out = [] if found is None else [(found["id"], found["cluster"], found["change"])]
    return m.cells.sparkSession.createDataFrame(out, "id bigint, cluster int, change double")


def chain(m: CoordMatrix, rows: DataFrame, cols: DataFrame, length: int = 5, kind: int | str = 1) -> DataFrame:
    """(step, id, cluster, change): up to ``length`` best moves one after the other, each row at most once, whether or not they gain."""
    state = Moves.of(m, rows, cols, kind)
    for _ in range(length):
        move = state.best()
        if move is None:
            break
        state.make(move)
    out = [(k, r["id"], r["cluster"], r["change"]) for k, r in enumerate(state.made)]
    return m.cells.sparkSession.createDataFrame(out, "step int, id bigint, cluster int, change double")


def local_search(m: CoordMatrix, rows: DataFrame, cols: DataFrame, length: int = 5, threshold: float = 1e-6, kind: int | str = 1, axis: str = "row") -> tuple[DataFrame, float]:
    """Labels of the axis after a chain of moves, of which the prefix with the lowest total is kept if it gains enough; and the gain, at most 0."""
    if axis == "col":
        return local_search(m.transpose(), cols, rows, length, threshold, kind)
    moves, total, best, best_total = chain(m, rows, cols, length, kind).orderBy("step").collect(), 0.0, 0, 0.0
    for k, r in enumerate(moves, 1):
        total += r["change"]
        if total < best_total:
            best, best_total = k, total
    if best_total >= -threshold:
        return rows, 0.0
    new = m.cells.sparkSession.createDataFrame([(r["id"], r["cluster"]) for r in moves[:best]], "id bigint, __to int")  # at most ``length`` rows
    return cut(rows.join(F.broadcast(new), "id", "left").select("id", F.coalesce("__to", "cluster").cast("int").alias("cluster"))), best_total


def alternating_search(m: CoordMatrix, rows: DataFrame, cols: DataFrame, length: int = 5, threshold: float = 1e-6, kind: int | str = 1, rounds: int = 20) -> tuple[DataFrame, DataFrame, list[float]]:
    """Chains of rows, then of columns, until neither gains; labels of both and the gains."""
    gains: list[float] = []
    for _ in range(rounds):
        rows, by_rows = local_search(m, rows, cols, length, threshold, kind)
        cols, by_cols = local_search(m, rows, cols, length, threshold, kind, axis="col")
        gains += [by_rows, by_cols]
        if not by_rows and not by_cols:
            break
    return rows, cols, gains
