"""Sparse matrices as relations ``(row bigint, col bigint, value double)``.

An absent cell is zero. A product is an equi-join with a grouped sum, so Spark combines partial sums
before it exchanges them; a mask is an anti-join. Shapes are carried beside the rows because empty
rows and columns do not occur among the cells.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import cut

SCHEMA = "row bigint, col bigint, value double"

#: Memory of a cell in a broadcast table, and of all that one task may be asked to hold.
CELL_BYTES, HELD_BYTES = 64, 256 << 20

#: Members of a group in a pack.
PACK = 1024


def in_steps(df: DataFrame) -> DataFrame:
    """``df``, its rows handed on one by one; partitions stay, as coalesce() to more than there are changes none. Two explodes in one generated loop would keep
    all rows made from one input row in memory, copied, before the next is read: a million for a pair of packs, where so it is a pack's."""
    return df.coalesce(1 << 20)


@dataclass(frozen=True)
class CoordMatrix:
    """``cells``: each position at most once. ``n_rows``, ``n_cols``: the shape, ids from 0."""

    cells: DataFrame
    n_rows: int
    n_cols: int

    @staticmethod
    def of(df: DataFrame, row: str, col: str, value: str | None = None, shape: tuple[int, int] | None = None) -> CoordMatrix:
        """Cells from an edge list; values at the same position are added, as sparse constructors do."""
        v = F.lit(1.0) if value is None else F.col(value).cast("double")
        cells = df.select(F.col(row).cast("bigint").alias("row"), F.col(col).cast("bigint").alias("col"), v.alias("value")).groupBy("row", "col").agg(F.sum("value").alias("value"))
        return CoordMatrix(cells, *(shape or extent(cells)))

    @staticmethod
    def from_rows(spark: SparkSession, rows: Iterable[tuple[int, int, float]], shape: tuple[int, int]) -> CoordMatrix:
        return CoordMatrix.of(spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in rows], SCHEMA), "row", "col", "value", shape)

    def _like(self, cells: DataFrame) -> CoordMatrix:
        return CoordMatrix(cells, self.n_rows, self.n_cols)

    def transpose(self) -> CoordMatrix:
        return CoordMatrix(self.cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), self.n_cols, self.n_rows)

    def scale(self, by: float) -> CoordMatrix:
        return self._like(self.cells.withColumn("value", F.col("value") * by))

    def map_values(self, f) -> CoordMatrix:
        """``f``: Column to Column, with f(0) = 0."""
        return self._like(self.cells.withColumn("value", f(F.col("value"))))

    def add(self, other: CoordMatrix, times: float = 1.0) -> CoordMatrix:
        both = self.cells.unionByName(other.scale(times).cells if times != 1.0 else other.cells)
        return self._like(both.groupBy("row", "col").agg(F.sum("value").alias("value")))

    def multiply(self, other: CoordMatrix) -> CoordMatrix:
        if self.n_cols != other.n_rows:
            raise ValueError(f"cannot multiply {self.n_rows}x{self.n_cols} by {other.n_rows}x{other.n_cols}")
        a = self.cells.select("row", F.col("col").alias("__k"), F.col("value").alias("__a"))
        b = other.cells.select(F.col("row").alias("__k"), "col", F.col("value").alias("__b"))
        return CoordMatrix(a.join(b, "__k").groupBy("row", "col").agg(F.sum(F.col("__a") * F.col("__b")).alias("value")), self.n_rows, other.n_cols)

    def multiply_held(self, other: CoordMatrix, most_bytes: int = HELD_BYTES) -> CoordMatrix:
        """The same product. Where ``other`` is stored and its cells, counted, take at most ``most_bytes``, each task holds it whole and this
        matrix is dealt by row: the sums of a row come together in one place, and no partial product is exchanged. A larger one is joined.
        Where both are stored and tasks are few, joining is faster: at sf0.1 the two-hop scores took 31 s this way and 17 s joined."""
        stored = CoordMatrix(cut(other.cells.select("row", "col", "value")), other.n_rows, other.n_cols)
        if CELL_BYTES * stored.cells.count() > most_bytes:
            return self.multiply(stored)
        a = self.cells.select("row", F.col("col").alias("__k"), F.col("value").alias("__a")).repartition("row")
        b = stored.cells.select(F.col("row").alias("__k"), "col", F.col("value").alias("__b"))
        return CoordMatrix(a.join(F.broadcast(b), "__k").groupBy("row", "col").agg(F.sum(F.col("__a") * F.col("__b")).alias("value")), self.n_rows, other.n_cols)

    def row_counts(self) -> DataFrame:
        """(id, n) of each row that has cells."""
        return self.cells.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("n"))

    def skeleton(self) -> CoordMatrix:
        """A graph with the same connected components."""
        return self

    def stored(self) -> CoordMatrix:
        """The same, computed once."""
        return self._like(cut(self.cells.select("row", "col", "value")))

    def links_to(self, labels: DataFrame) -> DataFrame:
        """(id, cluster, l): each row's sum of cells by the label of their columns; ``labels``: (id, cluster)."""
        to = labels.select(F.col("id").alias("col"), "cluster")
        return self.cells.join(to, "col").groupBy(F.col("row").alias("id"), "cluster").agg(F.sum("value").alias("l"))

    def label_sums(self, labels: DataFrame) -> DataFrame:
        """(cluster, volume, inside): sums of the cells between labelled rows and columns, and of those within the cluster, by the row's label."""
        rows, cols = labels.select(F.col("id").alias("row"), "cluster"), labels.select(F.col("id").alias("col"), F.col("cluster").alias("__to"))
        inside = F.sum(F.when(F.col("cluster") == F.col("__to"), F.col("value")).otherwise(0.0))
        return self.cells.join(rows, "row").join(cols, "col").groupBy("cluster").agg(F.sum("value").alias("volume"), inside.alias("inside"))

    def contracted(self, parents: DataFrame) -> CoordMatrix:
        """Rows and columns of one parent added up; ``parents``: (id, parent)."""
        up = lambda axis: parents.select(F.col("id").alias(axis), F.col("parent").alias(f"__{axis}"))
        cells = self.cells.join(up("row"), "row").join(up("col"), "col").groupBy("__row", "__col").agg(F.sum("value").alias("value"))
        return self._like(cells.select(F.col("__row").alias("row"), F.col("__col").alias("col"), "value"))

    def hadamard(self, other: CoordMatrix) -> CoordMatrix:
        b = other.cells.withColumnRenamed("value", "__b")
        return self._like(self.cells.join(b, ["row", "col"]).select("row", "col", (F.col("value") * F.col("__b")).alias("value")))

    def divide_on_pattern(self, other: CoordMatrix) -> CoordMatrix:
        """a / b where both have a cell."""
        b = other.cells.withColumnRenamed("value", "__b")
        return self._like(self.cells.join(b, ["row", "col"]).select("row", "col", (F.col("value") / F.col("__b")).alias("value")))

    def without(self, known: CoordMatrix) -> CoordMatrix:
        """Cells at positions where ``known`` has none."""
        return self._like(self.cells.join(known.cells.select("row", "col"), ["row", "col"], "left_anti"))

    def slice(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> CoordMatrix:
        """Cells whose row (column) occurs in the ``id`` column given; ids stay as they are."""
        cells = self.cells
        if rows is not None:
            cells = cells.join(rows.select(F.col("id").alias("row")), "row", "left_semi")
        if cols is not None:
            cells = cells.join(cols.select(F.col("id").alias("col")), "col", "left_semi")
        return self._like(cells.select("row", "col", "value"))

    def permute(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> CoordMatrix:
        """``rows``, ``cols``: (old, new) of each id."""
        cells = self.cells
        for axis, key in (("row", rows), ("col", cols)):
            if key is not None:
                cells = cells.join(key.select(F.col("old").alias(axis), F.col("new").alias("__new")), axis).drop(axis).withColumnRenamed("__new", axis)
        return self._like(cells.select("row", "col", "value"))

    def upper(self, diagonal: bool = True) -> CoordMatrix:
        return self._like(self.cells.filter("row <= col" if diagonal else "row < col"))

    def symmetrised(self) -> CoordMatrix:
        """The pattern of A + A', all values 1."""
        both = self.cells.select("row", "col").unionByName(self.cells.select(F.col("col").alias("row"), F.col("row").alias("col")))
        return self._like(both.distinct().withColumn("value", F.lit(1.0)))

    def block_with(self, other: CoordMatrix, below: bool) -> CoordMatrix:
        """[A B] or [A; B]."""
        shift = F.lit(self.n_rows if below else self.n_cols)
        moved = other.cells.withColumn("row" if below else "col", F.col("row" if below else "col") + shift)
        shape = (self.n_rows + other.n_rows, max(self.n_cols, other.n_cols)) if below else (max(self.n_rows, other.n_rows), self.n_cols + other.n_cols)
        return CoordMatrix(self.cells.unionByName(moved), *shape)

    def vector_product(self, vector: DataFrame) -> DataFrame:
        """``vector``: (id, x). Returns (id, x) of A x."""
        v = vector.select(F.col("id").alias("col"), "x")
        return self.cells.join(v, "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("x")).alias("x"))

    def sums(self, axis: str) -> DataFrame:
        """(id, total) of each row (``axis`` row) or column that has cells."""
        return self.cells.groupBy(F.col(axis).alias("id")).agg(F.sum("value").alias("total"))

    def all_sums(self, axis: str) -> DataFrame:
        """The same for every id of the axis; empty ones have 0."""
        ids = self.cells.sparkSession.range(self.n_rows if axis == "row" else self.n_cols)
        return ids.join(self.sums(axis), "id", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total"))

    def density(self) -> DataFrame:
        return self.cells.agg((F.sum(F.when(F.col("value") != 0, 1).otherwise(0)) / F.lit(float(self.n_rows * self.n_cols))).alias("density"))

    def norm(self) -> DataFrame:
        return self.cells.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))

    def asymmetry(self) -> DataFrame:
        """One row: largest |a_ij - a_ji|, and whether it is 0."""
        t = self.transpose().cells.withColumnRenamed("value", "__t")
        gap = F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("__t", F.lit(0.0)))
        return self.cells.join(t, ["row", "col"], "full_outer").agg(F.max(gap).alias("max_imbalance")).select("max_imbalance", (F.coalesce("max_imbalance", F.lit(0.0)) == 0).alias("is_symmetric"))

    def unit_rows(self, axis: str = "row") -> CoordMatrix:
        """Each row (column) divided by its length; zero ones stay."""
        length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(axis)))
        return self._like(self.cells.withColumn("value", F.when(length > 0, F.col("value") / length).otherwise(F.col("value"))))

    def normalised_l1(self, axis: str = "col") -> CoordMatrix:
        total = F.sum(F.abs("value")).over(Window.partitionBy(axis))
        return self._like(self.cells.withColumn("value", F.when(total > 0, F.col("value") / total).otherwise(F.col("value"))))

    def laplacian_normalised(self, floor: float = 1e-6) -> CoordMatrix:
        """D^-1/2 A D^-1/2 with column sums as degrees; a degree of 0 counts as ``floor``."""
        degree = self.sums("col").select("id", F.when(F.col("total") == 0, floor).otherwise(F.col("total")).alias("d"))
        a = self.cells.join(degree.select(F.col("id").alias("row"), F.col("d").alias("__r")), "row", "left").join(degree.select(F.col("id").alias("col"), F.col("d").alias("__c")), "col", "left")
        return self._like(a.select("row", "col", (F.col("value") / F.sqrt(F.coalesce("__r", F.lit(floor)) * F.coalesce("__c", F.lit(floor)))).alias("value")))

    def balanced_by_diagonal(self) -> CoordMatrix:
        """(A + diag(max(s) - s)) / max(s) with s the absolute row sums."""
        s = self.cells.groupBy("row").agg(F.sum(F.abs("value")).alias("s"))
        ids = self.cells.sparkSession.range(self.n_rows).select(F.col("id").alias("row")).join(s, "row", "left").select("row", F.coalesce("s", F.lit(0.0)).alias("s"))
        top = s.agg(F.max("s")).first()[0] or 1.0
        diagonal = ids.select("row", F.col("row").alias("col"), (F.lit(top) - F.col("s")).alias("value"))
        both = self.cells.unionByName(diagonal).groupBy("row", "col").agg((F.sum("value") / top).alias("value"))
        return self._like(both)

    def balanced_by_scaling(self, most: int = 100, tolerance: float = 1e-6) -> tuple[CoordMatrix, int]:
        """Rows, then columns are brought to length 1, until entry and mirrored entry differ by less than ``tolerance`` or ``most`` rounds are done; and the rounds."""
        m = self
        for k in range(1, most + 1):
            m = self._like(cut(m.unit_rows("row").unit_rows("col").cells.select("row", "col", "value")))
            if (m.asymmetry().first()["max_imbalance"] or 0.0) < tolerance:
                break
        return m, k if most else 0

    def has_negative(self) -> DataFrame:
        """One row: whether a value is below 0, as guards of divergences ask."""
        return self.cells.agg(F.coalesce(F.max(F.col("value") < 0), F.lit(False)).alias("has_negative"))

    def sampled_product(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """For each cell (i, j) the dot product of left[i] and right[j]; both (id, vec array<double>)."""
        a, b = left.select(F.col("id").alias("row"), F.col("vec").alias("__a")), right.select(F.col("id").alias("col"), F.col("vec").alias("__b"))
        dot = F.aggregate(F.zip_with("__a", "__b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return self.cells.select("row", "col").join(a, "row").join(b, "col").select("row", "col", dot.alias("value"))


@dataclass(frozen=True)
class CliqueMatrix(CoordMatrix):
    """The graph in which all members of a group are linked, in factored form: ``groups`` has (id, group), an id once.

    As P P' - I with P the memberships: products go through the groups, so the links, as many as the square
    of a group's size, are made only where ``cells`` itself is asked for."""

    groups: DataFrame

    @staticmethod
    def of_groups(groups: DataFrame, n: int) -> CliqueMatrix:
        """Links are made from pairs of packs of ids, so a large group's are dealt to all tasks and only packs are exchanged."""
        sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
        dealt = groups.join(sizes, "group").select("group", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PACK)).alias("pack"))
        packs = dealt.groupBy("group", "pack").agg(F.collect_list("id").alias("ids"))
        a, b = packs.select("group", F.col("pack").alias("p"), F.col("ids").alias("a")), packs.select("group", F.col("pack").alias("q"), F.col("ids").alias("b"))
        tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = a.join(b, "group").repartition(tasks, F.xxhash64("group", "p", "q"))
        cells = in_steps(pairs.select(F.explode("a").alias("row"), "b")).select("row", F.explode("b").alias("col")).filter("row <> col")
        return CliqueMatrix(cells.select("row", "col", F.lit(1.0).alias("value")), n, n, groups)

    def multiply(self, other: CoordMatrix) -> CoordMatrix:
        if self.n_cols != other.n_rows:
            raise ValueError(f"cannot multiply {self.n_rows}x{self.n_cols} by {other.n_rows}x{other.n_cols}")
        own = other.cells.join(self.groups.select(F.col("id").alias("row"), "group"), "row")
        sums = own.groupBy("group", "col").agg(F.sum("value").alias("value"))
        spread = self.groups.select(F.col("id").alias("row"), "group").join(sums, "group").select("row", "col", "value")
        minus = own.select("row", "col", F.col("value").alias("__own"))
        left = spread.join(minus, ["row", "col"], "left").filter("__own IS NULL OR value <> __own")  # a group's sum that is the row's own alone leaves no cell
        return CoordMatrix(left.select("row", "col", (F.col("value") - F.coalesce("__own", F.lit(0.0))).alias("value")), self.n_rows, other.n_cols)

    def slice(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> CoordMatrix:
        if rows is None or cols is not rows:
            return CoordMatrix.slice(self, rows, cols)
        return CliqueMatrix.of_groups(self.groups.join(rows.select("id"), "id", "left_semi"), self.n_rows)

    def row_counts(self) -> DataFrame:
        sizes = self.groups.groupBy("group").agg((F.count("*") - 1).alias("n"))
        return self.groups.join(sizes, "group").filter("n > 0").select("id", "n")

    def skeleton(self) -> CoordMatrix:
        """Each member linked with its group's smallest."""
        low = self.groups.groupBy("group").agg(F.min("id").alias("col"))
        links = self.groups.join(low, "group").select(F.col("id").alias("row"), "col", F.lit(1.0).alias("value")).filter("row <> col")
        return CoordMatrix(links, self.n_rows, self.n_cols)


@dataclass(frozen=True)
class FactoredMatrix(CoordMatrix):
    """A symmetric matrix of ``loose`` cells plus, for each group, ``weight`` * share of a * share of b for all members a and b.

    ``shares``: (id, group, share). Loose cells hold what the groups' products give too much on the diagonal, as negative values. Sums and contractions go through
    shares and loose cells; ``cells``, as many as the squares of the groups, is made only where it is asked for."""

    loose: DataFrame
    shares: DataFrame
    weight: float

    @staticmethod
    def of(loose: DataFrame, shares: DataFrame, weight: float, n: int, cells: DataFrame | None = None) -> FactoredMatrix:
        """``cells``: the same cells made in a plainer way, where there is one."""
        if cells is None:
            a, b = shares.select(F.col("id").alias("row"), "group", F.col("share").alias("__a")), shares.select(F.col("id").alias("col"), "group", F.col("share").alias("__b"))
            grouped = a.join(b, "group").select("row", "col", (F.lit(weight) * F.col("__a") * F.col("__b")).alias("value"))
            cells = loose.select("row", "col", "value").unionByName(grouped).groupBy("row", "col").agg(F.sum("value").alias("value")).filter("value <> 0")
        return FactoredMatrix(cells, n, n, loose, shares, weight)

    def _loose(self) -> CoordMatrix:
        return CoordMatrix(self.loose, self.n_rows, self.n_cols)

    def stored(self) -> FactoredMatrix:
        return FactoredMatrix.of(cut(self.loose.select("row", "col", "value")), cut(self.shares.select("id", "group", "share")), self.weight, self.n_rows)

    def sums(self, axis: str) -> DataFrame:
        whole = self.shares.groupBy("group").agg(F.sum("share").alias("__all"))
        own = self.shares.join(whole, "group").select("id", (F.lit(self.weight) * F.col("share") * F.col("__all")).alias("total"))
        both = self.loose.select(F.col(axis).alias("id"), F.col("value").alias("total")).unionByName(own)
        return both.groupBy("id").agg(F.sum("total").alias("total")).filter("total <> 0")

    def _by_label(self, labels: DataFrame) -> DataFrame:
        return self.shares.join(labels.select("id", "cluster"), "id").groupBy("group", "cluster").agg(F.sum("share").alias("__s"))

    def links_to(self, labels: DataFrame) -> DataFrame:
        own = self.shares.join(self._by_label(labels), "group").select("id", "cluster", (F.lit(self.weight) * F.col("share") * F.col("__s")).alias("l"))
        return self._loose().links_to(labels).unionByName(own).groupBy("id", "cluster").agg(F.sum("l").alias("l")).filter("l <> 0")

    def label_sums(self, labels: DataFrame) -> DataFrame:
        s = self._by_label(labels)
        whole = s.groupBy("group").agg(F.sum("__s").alias("__all"))
        own = s.join(whole, "group").select("cluster", (F.lit(self.weight) * F.col("__s") * F.col("__all")).alias("volume"), (F.lit(self.weight) * F.col("__s") * F.col("__s")).alias("inside"))
        both = self._loose().label_sums(labels).unionByName(own).groupBy("cluster").agg(F.sum("volume").alias("volume"), F.sum("inside").alias("inside"))
        return both.filter("volume <> 0")

    def contracted(self, parents: DataFrame) -> FactoredMatrix:
        shares = self.shares.join(parents, "id").groupBy(F.col("parent").alias("id"), "group").agg(F.sum("share").alias("share"))
        return FactoredMatrix.of(self._loose().contracted(parents).cells, shares, self.weight, self.n_rows)


def value_ranks(items: DataFrame, value: str = "value", id_col: str = "id") -> DataFrame:
    """``items`` with the place of each value in ascending order, from 0; equal values in the order of their ids."""
    return numbered(items, value, id_col, "rank")


def numbered(df: DataFrame, key: str, then: str | Column, name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``key``, nulls first, then ``then``.

    Rows are sorted by ranges of both, so a value that many rows share is spread over tasks as well; a row's place is its number in its range behind the
    sizes of the ranges before, of which the driver gets one number each."""
    order = [F.asc_nulls_first(key), F.col(then) if isinstance(then, str) else then]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", 33).cast("int"))
    before, at = [], 0
    for r in placed.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # one row a task
        before.append((r["__range"], at - (r["__range"] << 33)))
        at += r["n"]
    start = df.sparkSession.createDataFrame(before, "__range int, __shift bigint")
    return placed.join(F.broadcast(start), "__range").withColumn(name, F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")


def range_of(key: Column, bounds: list) -> Column:
    """How many of a bounded number of sorted bounds lie below ``key``."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < key)), F.lit(0))


def extent(cells: DataFrame) -> tuple[int, int]:
    r = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return (0, 0) if r["r"] is None else (r["r"] + 1, r["c"] + 1)


def linear_index(n_rows: int) -> Column:
    """Place of a cell in column order, which decides among equal scores."""
    return F.col("col") * F.lit(n_rows) + F.col("row")


def weighted_sum(parts: list[tuple[float, CoordMatrix]]) -> CoordMatrix:
    """Sum of scaled matrices of one shape, in one grouped sum."""
    cells = None
    for weight, m in parts:
        own = m.scale(weight).cells
        cells = own if cells is None else cells.unionByName(own)
    first = parts[0][1]
    return CoordMatrix(cells.groupBy("row", "col").agg(F.sum("value").alias("value")), first.n_rows, first.n_cols)
