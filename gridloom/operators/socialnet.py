"""Filters and statistics of social networks with group memberships."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..matrix import CELL_BYTES, HELD_BYTES, CliqueMatrix, CoordMatrix, FactoredMatrix
from ..session import cut
from . import rowwise


@dataclass(frozen=True)
class SocialNet:
    """Friendships (both directions) and memberships; methods return a changed copy."""

    user_user: CoordMatrix
    user_group: CoordMatrix

    def group_sizes(self) -> DataFrame:
        return self.user_group.cells.groupBy(F.col("col").alias("id")).agg(F.count("*").alias("n"))

    def memberships(self) -> DataFrame:
        return self.user_group.cells.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("n"))

    def _groups(self, test: str) -> SocialNet:
        return replace(self, user_group=self.user_group.slice(cols=self.group_sizes().filter(test)))

    def _users(self, ids: DataFrame) -> SocialNet:
        return SocialNet(self.user_user.slice(ids, ids), self.user_group.slice(rows=ids))

    def leading_groups(self, size: int) -> SocialNet:
        """Groups of more than ``size`` members, and the users they have."""
        kept = self._groups(f"n > {size}")
        return kept._users(kept.memberships())

    def without_large_groups(self, size: int) -> SocialNet:
        return self._groups(f"n <= {size}")

    def without_tiny_groups(self, size: int) -> SocialNet:
        return self._groups(f"n >= {size}")

    def with_memberships(self, more_than: int) -> SocialNet:
        return self._users(self.memberships().filter(f"n > {more_than}"))

    def with_friends(self, at_least: int) -> SocialNet:
        """Users of at least so many friends, then groups that still have a member."""
        friends = self.user_user.row_counts()
        return self._users(friends.filter(f"n >= {at_least}")).without_tiny_groups(1)

    def sample_users(self, n: int, key: str = "(id * 7919 + 17) % 1000003") -> SocialNet:
        """``n`` users in the order of an arithmetic key, and what lies among them."""
        ids = self.user_user.row_counts().select("id").unionByName(self.user_group.cells.select(F.col("row").alias("id"))).distinct()
        return self._users(ids.orderBy(F.expr(key), "id").limit(n))

    def small_network(self, group_size: int, users: int, friends: int) -> SocialNet:
        return self.leading_groups(group_size).sample_users(users).with_friends(friends)

    def crawl(self, start: int, most: int) -> DataFrame:
        """Users found breadth first from ``start`` until ``most`` are known; the last ring comes whole. (id, depth)."""
        edges = self.user_user.cells.select(F.col("row").alias("id"), F.col("col").alias("to"))
        found = edges.sparkSession.createDataFrame([(start, 0)], "id bigint, depth int")
        depth, known = 0, 1
        while known < most:
            ring = found.filter(F.col("depth") == depth).join(edges, "id").select(F.col("to").alias("id")).distinct().join(found, "id", "left_anti")
            depth += 1
            found = cut(found.unionByName(ring.withColumn("depth", F.lit(depth))))
            now = found.count()
            if now == known:
                break
            known = now
        return found

    def merged(self, friend_weight: float = 5.0) -> CoordMatrix:
        """[w*UU UG; UG' 0]."""
        n = self.user_group.n_rows
        uu = self.user_user.scale(friend_weight).cells
        right = self.user_group.cells.withColumn("col", F.col("col") + n)
        left = right.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
        size, cells = n + self.user_group.n_cols, uu.unionByName(right).unionByName(left)
        if not isinstance(self.user_user, CliqueMatrix):
            return CoordMatrix(cells, size, size)
        shares = self.user_user.groups.select("id", "group", F.lit(1.0).alias("share"))
        itself = shares.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(-friend_weight).alias("value"))
        return FactoredMatrix.of(right.unionByName(left).unionByName(itself), shares, friend_weight, size, cells)

    def statistics(self) -> DataFrame:
        """Mean, least, largest and most frequent (smallest of several) number of memberships and friends."""

        def of(counts: DataFrame, name: str) -> DataFrame:
            often = counts.groupBy("n").agg(F.count("*").alias("k"))
            mode = often.agg(F.min_by("n", F.struct(-F.col("k"), "n")).alias("mode"))
            base = counts.agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("largest"), F.count("*").alias("users"))
            return base.crossJoin(mode).select(F.lit(name).alias("what"), "mean", "least", "largest", "mode", "users")  # one row each

        friends = self.user_user.row_counts()
        return of(self.memberships(), "memberships").unionByName(of(friends, "friends")).unionByName(of(self.group_sizes(), "members"))


def bipartite_adjacency(b: CoordMatrix) -> CoordMatrix:
    """[0 B; B' 0]."""
    right = b.cells.withColumn("col", F.col("col") + b.n_rows)
    both = right.unionByName(right.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    return CoordMatrix(both, b.n_rows + b.n_cols, b.n_rows + b.n_cols)


def two_hop(b: CoordMatrix) -> CoordMatrix:
    """B (B' B) where B has no cell: columns reached through shared rows. The smaller product comes first."""
    return b.multiply(b.transpose().multiply(b)).without(b)


def two_hop_scores(b: CoordMatrix, most_bytes: int = HELD_BYTES, best: int | None = None) -> DataFrame:
    """The cells of :func:`two_hop`; with ``best`` only each row's so many strongest ones, equal ones by column.

    B' B is stored and its cells are counted. Rows are dealt once, each whole to one task, and meet B' B in blocks of columns that each task can hold, so
    a row's scores come together where the row lies: what is exchanged afterwards are at most ``best`` cells of a row and block. A cell of B itself is
    told by its own column among the row's, so nothing has to be taken away in a further join."""
    gram = cut(b.transpose().multiply(b).cells.select(F.col("row").alias("__k"), "col", F.col("value").alias("__b")))
    blocks = max(1, -(-CELL_BYTES * gram.count() // most_bytes))
    rows = b.cells.select("row", F.col("col").alias("__k"), F.col("value").alias("__a")).repartition("row")
    out = None
    for k in range(blocks):
        held = gram if blocks == 1 else gram.filter(F.pmod(F.xxhash64("col"), F.lit(blocks)) == k)
        sums = rows.join(F.broadcast(held), "__k").groupBy("row", "col").agg(F.sum(F.col("__a") * F.col("__b")).alias("value"), F.max(F.col("__k") == F.col("col")).alias("__known"))
        sums = sums.filter("NOT __known").select("row", "col", "value")
        if best is not None:
            place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("value"), "col"))
            sums = sums.withColumn("__place", place).filter(F.col("__place") <= best).drop("__place")
        out = sums if out is None else out.unionByName(sums)
    return out


def two_hop_links(b: CoordMatrix, n: int) -> DataFrame:
    """The ``n`` strongest cells of :func:`two_hop`, equal ones by column, then row."""
    found = rowwise.multiply(b, b.transpose().multiply(b), strongest=n, unknown=True).cells
    return found.orderBy(F.desc("value"), "col", "row").limit(n)


def recommend(b: CoordMatrix, k: int) -> DataFrame:
    """For every row its ``k`` strongest two-hop columns: (row, col, value, place)."""
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("value"), "col"))
    found = rowwise.multiply(b, b.transpose().multiply(b), best=k, unknown=True).cells
    return found.withColumn("place", place).filter(F.col("place") <= k)


MERGED_LAYOUTS = (
    "[UG l*UU]", "[l*UU UG; UG' 0]", "[UG; D/|UG|] with D = UG' UG", "as 2 with l*D/|UG|", "as 2 with D/max(D)", "as 2 with l*D/max(D)", "as 5 with D = UG' UU UG",
)


def merged_layout(user_user: CoordMatrix, user_group: CoordMatrix, weight: float, kind: int) -> CoordMatrix:
    """One of seven ways to join friendships and memberships in a matrix; see MERGED_LAYOUTS."""
    if kind == 0:
        return user_group.block_with(user_user.scale(weight), below=False)
    if kind == 1:
        return SocialNet(user_user, user_group).merged(weight)
    gram = user_group.transpose().multiply(user_user.multiply(user_group) if kind == 6 else user_group)
    size = user_group.norm().first()[0] if kind in (2, 3) else gram.cells.agg(F.max("value")).first()[0]
    d = gram.scale((1.0 if kind in (2, 4) else weight) / (size or 1.0))
    n = user_group.n_rows
    right = user_group.cells
    below = d.cells.withColumn("row", F.col("row") + n)
    return CoordMatrix(right.unionByName(below), n + user_group.n_cols, user_group.n_cols)


def author_journal(author_doc: CoordMatrix, labels: DataFrame) -> CoordMatrix:
    """Documents of each author by label (doc, journal), each author's row of unit length."""
    j = author_doc.cells.join(labels.select(F.col("doc").alias("col"), "journal"), "col").groupBy("row", F.col("journal").cast("bigint").alias("__j")).agg(F.sum("value").alias("value"))
    width = (labels.agg(F.max("journal")).first()[0] or 0) + 1
    return CoordMatrix(j.select("row", F.col("__j").alias("col"), "value"), author_doc.n_rows, width).unit_rows()
