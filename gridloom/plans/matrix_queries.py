"""Queries of matrix algebra, networks and rankings over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..matrix import CoordMatrix, value_ranks, weighted_sum
from ..operators import graph, katz, multilevel, ranking, socialnet
from ..session import cut
from . import inputs as I  # noqa: E741, N812

UG, UU, NN, NS, UP = I.USER_GROUP, I.USER_USER, I.NATION_NET, I.NATION_SPARSE, I.USER_PART
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its own name, with the SQL that states the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _half_up(name: str, digits: int):
    """Rounded as by round(), in floating point: that one goes through decimals, which is felt in billions of cells. Values too large to have such digits stay."""
    v, by = F.col(name), 10.0**digits
    return F.when(F.abs(v) < 2.0**51 / by, F.signum(v) * F.floor(F.abs(v) * by + 0.5) / by + 0.0).otherwise(v).alias(name)


_TWO_HOP = f"""{UG}, aa AS (SELECT a.col AS c1, b.col AS c2, count(*)::DOUBLE AS v FROM ug a JOIN ug b ON a.row = b.row GROUP BY 1, 2),
hop AS (SELECT ug.row, aa.c2 AS col, sum(aa.v) AS value FROM ug JOIN aa ON ug.col = aa.c1 GROUP BY 1, 2),
two AS (SELECT * FROM hop ANTI JOIN ug ON hop.row = ug.row AND hop.col = ug.col)"""


@query(f"WITH {_TWO_HOP} SELECT row, col, value, place FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY value DESC, col) AS place FROM two) WHERE place <= 10")
def recommend_two_hop(spark, sf_dir):
    return socialnet.recommend(I.user_group(spark, sf_dir), 10)


@query(f"WITH {_TWO_HOP} SELECT row, col, value FROM two ORDER BY value DESC, col, row LIMIT 100")
def two_hop_links(spark, sf_dir):
    return socialnet.two_hop_links(I.user_group(spark, sf_dir), 100)


@query(f"WITH {UG} SELECT a.col AS row, b.col AS col, count(*)::DOUBLE AS value FROM ug a JOIN ug b ON a.row = b.row GROUP BY 1, 2")
def matrix_product(spark, sf_dir):
    m = I.user_group(spark, sf_dir)
    return m.transpose().multiply(m).cells


@query(f"WITH {NN} SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, coalesce(a.value, 0) - 2 * coalesce(b.value, 0) AS value FROM nn a FULL JOIN (SELECT col AS row, row AS col, value FROM nn) b ON a.row = b.row AND a.col = b.col")
def matrix_difference(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    return m.add(m.transpose(), -2.0).cells


@query(f"WITH {NN} SELECT a.row, a.col, round(a.value * b.value, 6) AS product, round(a.value / b.value, 6) AS quotient FROM nn a JOIN nn b ON a.row = b.col AND a.col = b.row")
def matrix_elementwise(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    h = m.hadamard(m.transpose()).cells.withColumnRenamed("value", "product")
    d = m.divide_on_pattern(m.transpose()).cells.withColumnRenamed("value", "quotient")
    return h.join(d, ["row", "col"]).select("row", "col", _r("product"), _r("quotient"))


@query(f"WITH {NN} SELECT row, col, round(value / sqrt(sum(value * value) OVER (PARTITION BY row)), 9) AS unit, round(value / sum(abs(value)) OVER (PARTITION BY col), 9) AS share FROM nn")
def matrix_normalised(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    a = m.unit_rows().cells.withColumnRenamed("value", "unit")
    return a.join(m.normalised_l1().cells.withColumnRenamed("value", "share"), ["row", "col"]).select("row", "col", _r("unit", 9), _r("share", 9))


@query(f"WITH {NS}, d AS (SELECT col, sum(value) AS d FROM ns GROUP BY 1) SELECT ns.row, ns.col, round(value / sqrt(a.d * b.d), 9) AS value FROM ns JOIN d a ON ns.row = a.col JOIN d b ON ns.col = b.col")
def matrix_laplacian(spark, sf_dir):
    return I.nation_net(spark, sf_dir, sparse=True).laplacian_normalised().cells.select("row", "col", _r("value", 9))


@query(f"WITH {NN}, s AS (SELECT i AS row, coalesce(s, 0) AS s FROM range(25) t(i) LEFT JOIN (SELECT row, sum(abs(value)) AS s FROM nn GROUP BY 1) ON row = i), d AS (SELECT row, row AS col, (SELECT max(s) FROM s) - s AS value FROM s) SELECT row, col, round(sum(value) / (SELECT max(s) FROM s), 9) AS value FROM (SELECT * FROM nn UNION ALL SELECT * FROM d) GROUP BY 1, 2")
def matrix_balanced(spark, sf_dir):
    return I.nation_net(spark, sf_dir).balanced_by_diagonal().cells.select("row", "col", _r("value", 9))


@query(f"WITH {NN} SELECT max(abs(coalesce(a.value, 0) - coalesce(b.value, 0))) AS max_imbalance, max(abs(coalesce(a.value, 0) - coalesce(b.value, 0))) = 0 AS is_symmetric FROM nn a FULL JOIN (SELECT col AS row, row AS col, value FROM nn) b ON a.row = b.row AND a.col = b.col")
def matrix_asymmetry(spark, sf_dir):
    return I.nation_net(spark, sf_dir).asymmetry()


@query(f"WITH {UG} SELECT 'row' AS axis, min(t) AS least, max(t) AS largest, round(avg(t), 6) AS mean, sum(CASE WHEN t = 0 THEN 1 ELSE 0 END)::BIGINT AS empty FROM (SELECT coalesce(n, 0)::DOUBLE AS t FROM range((SELECT max(c_custkey) + 1 FROM customer)) r(i) LEFT JOIN (SELECT row, count(*) AS n FROM ug GROUP BY 1) ON row = i) UNION ALL SELECT 'col', min(t), max(t), round(avg(t), 6), sum(CASE WHEN t = 0 THEN 1 ELSE 0 END)::BIGINT FROM (SELECT coalesce(n, 0)::DOUBLE AS t FROM range((SELECT max(s_suppkey) + 1 FROM supplier)) r(i) LEFT JOIN (SELECT col, count(*) AS n FROM ug GROUP BY 1) ON col = i)")
def matrix_marginals(spark, sf_dir):
    m = I.user_group(spark, sf_dir)
    of = lambda axis: m.all_sums(axis).agg(F.min("total").alias("least"), F.max("total").alias("largest"), F.round(F.avg("total"), 6).alias("mean"), F.sum(F.when(F.col("total") == 0, 1).otherwise(0)).alias("empty")).select(F.lit(axis).alias("axis"), "least", "largest", "mean", "empty")
    return of("row").unionByName(of("col"))


@query(f"WITH {NN} SELECT round(count(*) / 625.0, 9) AS density, round(sqrt(sum(value * value)), 6) AS norm FROM nn WHERE value <> 0")
def matrix_density_norm(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    return m.density().crossJoin(m.norm()).select(_r("density", 9), _r("norm"))  # one row each


@query(f"WITH {NN} SELECT row, col + CASE WHEN side = 1 THEN 25 ELSE 0 END AS col, value FROM (SELECT *, 0 AS side FROM nn UNION ALL SELECT row, col, 3 * value, 1 FROM nn)")
def matrix_blocks(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    return m.block_with(m.scale(3.0), below=False).cells


@query(f"WITH {NN} SELECT (row * 7) % 25 AS row, 24 - col AS col, value FROM nn")
def matrix_permuted(spark, sf_dir):
    ids = spark.range(25)
    return I.nation_net(spark, sf_dir).permute(ids.select(F.col("id").alias("old"), ((F.col("id") * 7) % 25).alias("new")), ids.select(F.col("id").alias("old"), (24 - F.col("id")).alias("new"))).cells


@query(f"WITH {NN} SELECT row AS id, sum(value * (col + 1)) AS x FROM nn GROUP BY 1")
def matrix_vector(spark, sf_dir):
    return I.nation_net(spark, sf_dir).vector_product(spark.range(25).select("id", (F.col("id") + 1).cast("double").alias("x")))


@query(f"WITH {NN} SELECT row, col, round((row + 1.0) * (col + 2.0) + row * col, 6) AS value FROM nn")
def matrix_sampled_product(spark, sf_dir):
    ids = spark.range(25)
    left = ids.select("id", F.array((F.col("id") + 1).cast("double"), F.col("id").cast("double")).alias("vec"))
    right = ids.select("id", F.array((F.col("id") + 2).cast("double"), F.col("id").cast("double")).alias("vec"))
    return I.nation_net(spark, sf_dir).sampled_product(left, right)


@query(f"WITH {UG}, g AS (SELECT col FROM ug GROUP BY 1 HAVING count(*) > 40), k AS (SELECT ug.* FROM ug SEMI JOIN g USING (col)) SELECT row, col FROM k")
def network_leading_groups(spark, sf_dir):
    net = socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir))
    return net.leading_groups(40).user_group.cells.select("row", "col")


@query(f"WITH {UG}, g AS (SELECT col FROM ug GROUP BY 1 HAVING count(*) <= 60 AND count(*) >= 30) SELECT row, col FROM ug SEMI JOIN g USING (col)")
def network_middle_groups(spark, sf_dir):
    net = socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir))
    return net.without_large_groups(60).without_tiny_groups(30).user_group.cells.select("row", "col")


@query(f"WITH {UG}, {UU}, u AS (SELECT row AS id FROM ug GROUP BY 1 HAVING count(*) > 3) SELECT row, col FROM uu WHERE row IN (SELECT id FROM u) AND col IN (SELECT id FROM u)")
def network_active_users(spark, sf_dir):
    net = socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir))
    return net.with_memberships(3).user_user.cells.select("row", "col")


@query(f"WITH {UG}, {UU}, u AS (SELECT row AS id FROM uu GROUP BY 1 HAVING count(*) >= 2) SELECT row, col FROM ug WHERE row IN (SELECT id FROM u)")
def network_with_friends(spark, sf_dir):
    net = socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir))
    return net.with_friends(2).user_group.cells.select("row", "col")


@query(f"WITH {UG}, {UU}, ids AS (SELECT row AS id FROM uu UNION SELECT row FROM ug), u AS (SELECT id FROM ids ORDER BY (id * 7919 + 17) % 1000003, id LIMIT 200) SELECT row, col FROM ug WHERE row IN (SELECT id FROM u)")
def network_sampled_users(spark, sf_dir):
    net = socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir))
    return net.sample_users(200).user_group.cells.select("row", "col")


def _stats(table: str, key: str, name: str) -> str:
    return f"SELECT '{name}' AS what, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS largest, (SELECT n FROM (SELECT n, count(*) AS k FROM (SELECT count(*) AS n FROM {table} GROUP BY {key}) GROUP BY n) ORDER BY k DESC, n LIMIT 1) AS mode, count(*) AS users FROM (SELECT count(*) AS n FROM {table} GROUP BY {key})"


@query(f"WITH {UG}, {UU} {_stats('ug', 'row', 'memberships')} UNION ALL {_stats('uu', 'row', 'friends')} UNION ALL {_stats('ug', 'col', 'members')}")
def network_statistics(spark, sf_dir):
    net = socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir))
    return net.statistics().select("what", _r("mean"), "least", "largest", "mode", "users")


@query(f"WITH {UG}, {UU}, n AS (SELECT max(c_custkey) + 1 AS n FROM customer) SELECT row, col, 5 * value AS value FROM uu UNION ALL SELECT row, col + n, value FROM ug, n UNION ALL SELECT col + n, row, value FROM ug, n")
def network_merged(spark, sf_dir):
    return socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir)).merged().cells


@query(f"WITH {UG}, {UU}, g AS (SELECT a.col AS row, b.col AS col, count(*)::DOUBLE AS v FROM ug a JOIN ug b ON a.row = b.row GROUP BY 1, 2), n AS (SELECT max(c_custkey) + 1 AS n FROM customer) SELECT row, col, round(value, 9) AS value FROM ug UNION ALL SELECT row + n, col, round(0.4 * v / (SELECT max(v) FROM g), 9) FROM g, n")
def network_layout_5(spark, sf_dir):
    return socialnet.merged_layout(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir), 0.4, 5).cells.select("row", "col", _r("value", 9))


@query(f"WITH {UU}, {UG}, ba AS (SELECT uu.row, ug.col, sum(ug.value) AS v FROM uu JOIN ug ON uu.col = ug.row GROUP BY 1, 2), b2 AS (SELECT uu.row, ba.col, sum(ba.v) AS v FROM uu JOIN ba ON uu.col = ba.row GROUP BY 1, 2), aa AS (SELECT a.col AS c1, b.col AS c2, count(*) AS v FROM ug a JOIN ug b ON a.row = b.row GROUP BY 1, 2), a3 AS (SELECT ug.row, aa.c2 AS col, sum(aa.v) AS v FROM ug JOIN aa ON ug.col = aa.c1 GROUP BY 1, 2) SELECT row, col, round(sum(v), 6) AS value FROM (SELECT row, col, 0.2 * v AS v FROM ba UNION ALL SELECT row, col, 0.01 * 0.04 * v FROM b2 UNION ALL SELECT row, col, 0.01 * v FROM a3) GROUP BY 1, 2")
def katz_joint3(spark, sf_dir):
    return katz.joint3(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir), 0.2, -2).cells.select("row", "col", _half_up("value", 6))


@query(f"WITH {NS}, p2 AS (SELECT a.row, b.col, sum(a.value * b.value) AS value FROM ns a JOIN ns b ON a.col = b.row GROUP BY 1, 2), p3 AS (SELECT a.row, b.col, sum(a.value * b.value) AS value FROM p2 a JOIN ns b ON a.col = b.row GROUP BY 1, 2) SELECT row, col, round(sum(v), 9) AS value FROM (SELECT row, col, 0.05 * value AS v FROM ns UNION ALL SELECT row, col, 0.0025 * value FROM p2 UNION ALL SELECT row, col, 0.000125 * value FROM p3) GROUP BY 1, 2")
def katz_truncated(spark, sf_dir):
    return katz.truncated(I.nation_net(spark, sf_dir, sparse=True), 3, 0.05).cells.select("row", "col", _r("value", 9))


@query(f"WITH {UG}, g1 AS (SELECT a.col AS c1, b.col AS c2, count(*)::DOUBLE AS v FROM ug a JOIN ug b ON a.row = b.row GROUP BY 1, 2), g2 AS (SELECT a.c1, b.c2, sum(a.v * b.v) AS v FROM g1 a JOIN g1 b ON a.c2 = b.c1 GROUP BY 1, 2), g3 AS (SELECT a.c1, b.c2, sum(a.v * b.v) AS v FROM g2 a JOIN g1 b ON a.c2 = b.c1 GROUP BY 1, 2), p AS (SELECT c1, c2, sum(v) AS v FROM (SELECT c1, c2, 0.001 * v AS v FROM g1 UNION ALL SELECT c1, c2, 0.000001 * v FROM g2 UNION ALL SELECT c1, c2, 0.000000001 * v FROM g3) GROUP BY 1, 2) SELECT ug.row, p.c2 AS col, round(sum(p.v), 9) AS value FROM ug JOIN p ON ug.col = p.c1 GROUP BY 1, 2")
def katz_membership(spark, sf_dir):
    return katz.membership(I.user_group(spark, sf_dir), 1e-3).cells.select("row", "col", _half_up("value", 9))


@query(f"WITH {NS}, v1 AS (SELECT row AS id, 0.05 * sum(value * (col + 1)) AS x FROM ns GROUP BY 1), v2 AS (SELECT row AS id, 0.05 * sum(value * x) AS x FROM ns JOIN v1 ON col = id GROUP BY 1) SELECT id, round(sum(x), 9) AS x FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) GROUP BY 1")
def katz_propagated(spark, sf_dir):
    start = spark.range(25).select("id", (F.col("id") + 1).cast("double").alias("x"))
    return katz.propagate(I.nation_net(spark, sf_dir, sparse=True), start, 0.05, 2).select("id", _r("x", 9))


@query(f"WITH {NN} SELECT row, col, round(0.5 * value + 0.25 * coalesce((SELECT value FROM nn b WHERE b.row = a.col AND b.col = a.row), 0), 6) AS value FROM nn a UNION ALL SELECT col, row, round(0.25 * value, 6) FROM nn a WHERE NOT EXISTS (SELECT 1 FROM nn b WHERE b.row = a.col AND b.col = a.row)")
def katz_weighted_sum(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    return weighted_sum([(0.5, m), (0.25, m.transpose())]).cells.select("row", "col", _r("value"))


# Scaling and ranks

_UNIT = "SELECT row, col, value / sqrt(sum(value * value) OVER (PARTITION BY {axis})) AS value FROM {source}"


@query(f"WITH {NS}, a AS ({_UNIT.format(axis='row', source='ns')}), b AS ({_UNIT.format(axis='col', source='a')}), c AS ({_UNIT.format(axis='row', source='b')}), d AS ({_UNIT.format(axis='col', source='c')}) SELECT row, col, round(value, 9) AS value FROM d")
def matrix_scaled(spark, sf_dir):
    return I.nation_net(spark, sf_dir, sparse=True).balanced_by_scaling(2, 0.0)[0].cells.select("row", "col", _r("value", 9))


@query(f"WITH {NN} SELECT bool_or(value < 0) AS has_negative FROM nn")
def matrix_has_negative(spark, sf_dir):
    return I.nation_net(spark, sf_dir).has_negative()


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def matrix_value_ranks(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return value_ranks(orders).select("id", "rank")


# Rankings


def _evaluated(cuts: list[int], source: str, by: str) -> str:
    rows = ", ".join(f"({c})" for c in cuts)
    return f"""b AS (SELECT {by}, score, count(*) AS n, sum(target) AS t FROM {source} GROUP BY {by}, score),
c AS (SELECT *, coalesce(sum(n) OVER w, 0) AS above, coalesce(sum(t) OVER w, 0) AS t_above, sum(n) OVER (PARTITION BY {by}) AS all_n, sum(t) OVER (PARTITION BY {by}) AS all_t FROM b WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT {by}, n_top, t_above + t * (n_top - above)::DOUBLE / n AS hits, all_n, all_t FROM c JOIN (VALUES {rows}) k(n_top) ON above < n_top AND n_top <= above + n)"""


CUTS = [5, 10, 25, 50, 100]


@query(f"WITH {I.SCORED}, s AS (SELECT *, 0 AS one FROM scored), {_evaluated(CUTS, 's', 'one')} SELECT n_top, round(hits / n_top, 9) AS precision, round(hits / all_t, 9) AS sensitivity, round(1 - (n_top - hits) / (all_n - all_t), 9) AS specificity FROM e")
def rank_metrics(spark, sf_dir):
    return ranking.evaluate(I.scored(spark, sf_dir), CUTS).select("n_top", _r("precision", 9), _r("sensitivity", 9), _r("specificity", 9))


@query(f"WITH {I.SCORED}, s AS (SELECT item % 7 AS grp, score, target FROM scored), {_evaluated([1, 3, 5], 's', 'grp')} SELECT n_top, round(avg(hits / n_top), 9) AS precision, round(avg(hits / all_t), 9) AS sensitivity, round(avg(CASE WHEN all_n > all_t THEN 1 - (n_top - hits) / (all_n - all_t) END), 9) AS specificity, count(*) AS groups FROM e WHERE all_t > 0 GROUP BY 1")
def rank_metrics_by_group(spark, sf_dir):
    s = I.scored(spark, sf_dir).withColumn("grp", F.col("item") % 7)
    return ranking.evaluate_averaged(s, [1, 3, 5], "grp").select("n_top", _r("precision", 9), _r("sensitivity", 9), _r("specificity", 9), "groups")


@query(f"WITH {I.SCORED} SELECT round((sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)) / count(*), 9) AS auc FROM scored a JOIN scored b ON a.target = 1 AND b.target = 0")
def rank_auc(spark, sf_dir):
    return ranking.auc(I.scored(spark, sf_dir)).select(_r("auc", 9))


@query(f"WITH {I.SCORED} SELECT score, round((sum(n - target) OVER w) / (SELECT sum(1 - target) FROM scored), 9) AS fpr, round((sum(target) OVER w) / (SELECT sum(target) FROM scored), 9) AS tpr FROM (SELECT score, sum(target) AS target, count(*) AS n FROM scored GROUP BY 1) WINDOW w AS (ORDER BY score DESC)")
def rank_roc(spark, sf_dir):
    return ranking.roc(I.scored(spark, sf_dir)).select("score", _r("fpr", 9), _r("tpr", 9))


@query(f"WITH {I.SCORED} SELECT item, score, target FROM (SELECT *, rank() OVER (ORDER BY score DESC) AS r FROM scored) WHERE r <= 40")
def rank_top_with_ties(spark, sf_dir):
    return ranking.top_with_ties(I.scored(spark, sf_dir), 40)


@query(f"WITH {I.SCORED} SELECT item, score, target FROM scored s WHERE (SELECT count(*) FROM scored o WHERE o.score >= s.score) <= 40")
def rank_top_strict(spark, sf_dir):
    return ranking.top_strict(I.scored(spark, sf_dir), 40)


@query(f"WITH {UG} SELECT row, col, row_number() OVER (ORDER BY (row * 7919 + col * 104729) % 1000003, row, col) <= floor(0.8 * (SELECT count(*) FROM ug)) AS kept FROM ug")
def split_edges(spark, sf_dir):
    return ranking.split_edges(I.user_group(spark, sf_dir), 0.2).select("row", "col", "kept")


@query(f"WITH {UG} SELECT row, col, row_number() OVER (PARTITION BY row ORDER BY (row * 7919 + col * 104729) % 1000003, row, col) <= floor(0.6 * count(*) OVER (PARTITION BY row)) AS kept FROM ug")
def split_edges_by_row(spark, sf_dir):
    return ranking.split_edges(I.user_group(spark, sf_dir), 0.4, "row").select("row", "col", "kept")


@query(f"WITH {NN} SELECT row, col, value FROM nn WHERE value > 0 ORDER BY value DESC, col * 25 + row LIMIT 60")
def retain_top_cells(spark, sf_dir):
    return ranking.retain_top(I.nation_net(spark, sf_dir), 60)


# Clusters of the merged network

_MERGED = f"{UG}, {UU}, nu AS (SELECT max(c_custkey) + 1 AS n FROM customer), mg AS (SELECT row, col, 5 * value AS value FROM uu UNION ALL SELECT row, col + n, value FROM ug, nu UNION ALL SELECT col + n, row, value FROM ug, nu)"
_DEALT = f"{_MERGED}, lab AS (SELECT DISTINCT row AS id, (row % 4)::INT AS c FROM mg), cuts AS (SELECT l.c, sum(value) AS vol, sum(CASE WHEN l.c = t.c THEN value ELSE 0 END) AS ins FROM mg JOIN lab l ON row = l.id JOIN lab t ON col = t.id GROUP BY 1)"


def _merged_net(spark, sf_dir):
    """Stored, as its users read it several times."""
    return socialnet.SocialNet(I.user_user(spark, sf_dir), I.user_group(spark, sf_dir)).merged().stored()


def _dealt(m):
    return m.sums("row").select("id", (F.col("id") % 4).cast("int").alias("cluster"))


@query(f"WITH {_MERGED}, deg AS (SELECT row AS id, 1 / sum(value) AS w FROM mg GROUP BY 1), e AS (SELECT row AS a, col AS b, value * (x.w + y.w) AS score, (row * 7919 + col * 104729) % 1000003 AS k FROM mg JOIN deg x ON x.id = row JOIN deg y ON y.id = col WHERE row < col), ends AS (SELECT unnest([a, b]) AS id, a, b, score, k FROM e), best AS (SELECT a, b FROM ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, k DESC, a, b) = 1) SELECT a, b FROM best GROUP BY 1, 2 HAVING count(*) = 2")
def network_heavy_edges(spark, sf_dir):
    """The first round of the matching that contracts the merged network."""
    return multilevel.heaviest_mutual(_merged_net(spark, sf_dir))


@query(f"WITH {_DEALT} SELECT c AS cluster, vol AS volume, ins AS inside, round((vol - ins) / vol, 9) AS cut FROM cuts")
def network_dealt_cut(spark, sf_dir):
    m = _merged_net(spark, sf_dir)
    return multilevel.cluster_cuts(m, _dealt(m)).select("cluster", "volume", "inside", _r("cut", 9))


@query(f"""WITH {_DEALT}, s AS (SELECT *, sum(vol) OVER () AS t FROM cuts), deg AS (SELECT row AS id, sum(value) AS w FROM mg GROUP BY 1), lk AS (SELECT row AS id, c, sum(value) AS l FROM mg JOIN lab ON col = lab.id GROUP BY 1, 2),
o AS (SELECT id, c, sum(l) AS l FROM (FROM lk UNION ALL SELECT id, c, 0 FROM lab) GROUP BY 1, 2), d AS (SELECT o.id, o.c, lab.c <> o.c AS goes, round(ins / vol / vol * t - 2 * (l / w) / vol * t, 9) AS d FROM o JOIN s USING (c) JOIN deg USING (id) JOIN lab USING (id))
SELECT id, c AS cluster FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, goes, c) = 1""")
def network_kernel_step(spark, sf_dir):
    """One step of weighted kernel k-means on the merged network from dealt labels."""
    m = _merged_net(spark, sf_dir)
    return multilevel.kernel_step(m, _dealt(m))


def _network_clusters(m):
    return multilevel.cluster_graph(m, 4)


@query()
def network_clusters(spark, sf_dir):
    return _network_clusters(_merged_net(spark, sf_dir))


@query(f"WITH {_DEALT} SELECT round(sum((vol - ins) / vol), 9) AS dealt, true AS found_is_lower FROM cuts")
def network_cut_compared(spark, sf_dir):
    """The normalised cut of dealt labels, and whether that of the clusters found is below nine tenths of it."""
    m = _merged_net(spark, sf_dir)
    found = cut(_network_clusters(m).join(m.sums("row"), "id", "left_semi"))
    both = [multilevel.cluster_cuts(m, x).agg(F.sum("cut").alias(name)) for x, name in ((_dealt(m), "dealt"), (found, "found"))]
    return both[0].crossJoin(both[1]).select(_r("dealt", 9), (F.col("found") < 0.9 * F.col("dealt")).alias("found_is_lower"))  # one row each


# Graphs


@query(f"WITH {NS} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i + o)::BIGINT AS degree FROM (SELECT row AS id, 0 AS i, 1 AS o FROM ns UNION ALL SELECT col, 1, 0 FROM ns) GROUP BY 1")
def graph_degrees(spark, sf_dir):
    return graph.degrees(I.nation_net(spark, sf_dir, sparse=True))


@query(f"WITH {NS} SELECT count(*) AS edges, (SELECT max(s) FROM (SELECT sum(value) AS s FROM ns GROUP BY col)) AS max_degree FROM ns WHERE row <= col")
def graph_size(spark, sf_dir):
    m = I.nation_net(spark, sf_dir, sparse=True)
    return graph.edge_count(m).crossJoin(graph.max_degree(m))  # one row each


@query(f"WITH RECURSIVE {UU}, n AS (SELECT i AS id FROM range((SELECT max(c_custkey) + 1 FROM customer)) t(i)), walk(id, root) AS (SELECT id, id FROM n UNION SELECT uu.col, walk.root FROM walk JOIN uu ON walk.id = uu.row WHERE uu.col > walk.root) SELECT id, min(root) AS component FROM walk GROUP BY 1")
def graph_components(spark, sf_dir):
    return graph.components(I.user_user(spark, sf_dir))


@query(f"WITH {NS}, e AS (SELECT row, col, row_number() OVER (ORDER BY col, row) AS edge FROM ns WHERE row < col) SELECT row, col, edge FROM e UNION ALL SELECT col, row, edge FROM e")
def graph_edge_ids(spark, sf_dir):
    return graph.edge_ids(I.nation_net(spark, sf_dir, sparse=True))


@query(f"WITH {NS}, a AS (SELECT DISTINCT col AS id FROM ns WHERE row = 3), b AS (SELECT DISTINCT ns.col AS id FROM ns JOIN a ON ns.row = a.id) SELECT id FROM b")
def graph_two_step_neighbours(spark, sf_dir):
    return graph.k_neighbours(I.nation_net(spark, sf_dir, sparse=True), 3, 2)


@query(f"WITH {NS}, g AS (SELECT i AS row, i + 1 AS col FROM range(24) t(i)), s AS (SELECT row, col FROM ns WHERE row <= col) SELECT (SELECT count(*) FROM s ANTI JOIN g USING (row, col)) AS only_a, (SELECT count(*) FROM g ANTI JOIN s USING (row, col)) AS only_b")
def graph_edge_difference(spark, sf_dir):
    return graph.edge_difference(I.nation_net(spark, sf_dir, sparse=True), graph.generate(spark, "chain", 25))


@query(f"WITH {NS} SELECT (a.i % 3)::INT AS a, (b.i % 3)::INT AS b, count(*) AS n FROM ns JOIN range(25) a(i) ON row = a.i JOIN range(25) b(i) ON col = b.i WHERE row <= col GROUP BY 1, 2")
def graph_cluster_edges(spark, sf_dir):
    labels = spark.range(25).select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    return katz.cluster_edges(I.nation_net(spark, sf_dir, sparse=True), labels)


@query(f"WITH {NS}, e AS (SELECT (row % 3)::INT AS a, (col % 3)::INT AS b, count(*)::DOUBLE AS n FROM ns WHERE row <= col GROUP BY 1, 2), s AS (SELECT (i % 3)::INT AS c, count(*)::DOUBLE AS u FROM range(25) t(i) GROUP BY 1), x AS (SELECT e.n / (SELECT sum(n) FROM e WHERE a <= b) / 25 * e.n / (SELECT sum(n) FROM e f WHERE f.a = e.a) * (1 / p.u + 1 / q.u) AS v FROM e JOIN s p ON p.c = a JOIN s q ON q.c = b WHERE a <= b) SELECT round(sum(v) * 40, 9) AS precision, round(sum(v) * 100, 9) AS sensitivity FROM x")
def cluster_random_guess(spark, sf_dir):
    labels = spark.range(25).select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    edges = katz.cluster_edges(I.nation_net(spark, sf_dir, sparse=True), labels)
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("users"))
    return ranking.cluster_random_prediction(edges, sizes, 100, 40).select(_r("precision", 9), _r("sensitivity", 9))


_GRAPHS = """f AS (SELECT count(*) AS n, greatest(1, round(sqrt(count(*))))::BIGINT AS w FROM supplier), i AS (SELECT unnest(range(n)) AS i, n, w FROM f),
g AS (SELECT i AS a, i + 1 AS b FROM i WHERE i + 1 < n AND i % w <> w - 1 UNION SELECT i, i + w FROM i WHERE i + w < n),
e AS (SELECT 'grid' AS topology, a, b FROM g UNION SELECT '8ngrid', a, b FROM g UNION SELECT '8ngrid', i, i + w + 1 FROM i WHERE i + w + 1 < n AND i % w <> w - 1 UNION SELECT '8ngrid', i, i + w - 1 FROM i WHERE i + w - 1 < n AND i % w <> 0 AND w > 1
UNION SELECT 'star', 0, i FROM i WHERE i > 0 UNION SELECT 'chain', i, i + 1 FROM i WHERE i + 1 < n)"""


@query(f"WITH {_GRAPHS} SELECT topology, a AS row, b AS col FROM e UNION SELECT topology, b, a FROM e")
def graph_generated(spark, sf_dir):
    """Named graphs on as many nodes as there are suppliers."""
    n, out = I.table(spark, sf_dir, "supplier").count(), None
    for name in ("grid", "8ngrid", "star", "chain"):
        own = graph.generate(spark, name, n).cells.select(F.lit(name).alias("topology"), "row", "col")
        out = own if out is None else out.unionByName(own)
    return out


def _spanning_sql(edges: str) -> str:
    """``edges``: a CTE e of (row, col, value) in which an edge of the tree is one whose ends no better edges connect."""
    return f"""{edges}, o AS (SELECT *, row_number() OVER (ORDER BY value DESC, row, col) AS k FROM e),
walk(k, id) AS (SELECT k, row FROM o UNION SELECT w.k, CASE WHEN b.row = w.id THEN b.col ELSE b.row END FROM walk w JOIN o b ON b.k < w.k AND (b.row = w.id OR b.col = w.id))"""


@query(f"WITH RECURSIVE {_spanning_sql(f'{NN}, e AS (SELECT * FROM nn WHERE row < col)')} SELECT row, col, value FROM o WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.k = o.k AND walk.id = o.col)")
def graph_spanning_tree(spark, sf_dir):
    return graph.spanning_tree(I.nation_net(spark, sf_dir), largest=True)


@query(f"WITH RECURSIVE {UU}, n AS (SELECT i AS id FROM range((SELECT max(c_custkey) + 1 FROM customer)) t(i)), walk(id, root) AS (SELECT id, id FROM n UNION SELECT uu.col, walk.root FROM walk JOIN uu ON walk.id = uu.row WHERE uu.col > walk.root), roots AS (SELECT DISTINCT min(root) AS root FROM walk GROUP BY id), links AS (SELECT lag(root) OVER (ORDER BY root) AS row, root AS col FROM roots) SELECT row, col FROM uu WHERE row < col UNION SELECT row, col FROM links WHERE row IS NOT NULL")
def graph_supergraph(spark, sf_dir):
    return graph.connected_supergraph(I.user_user(spark, sf_dir)).cells.filter("row < col").select("row", "col")


@query(f"WITH d AS (SELECT p_partkey, p_size FROM part), aj AS (SELECT o_custkey AS row, (p_size % 12)::BIGINT AS col, count(*)::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN d ON l_partkey = p_partkey GROUP BY 1, 2) SELECT row, col, round(v / sqrt(sum(v * v) OVER (PARTITION BY row)), 9) AS value FROM aj")
def author_journal(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    docs = lines.join(I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    labels = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_size") % 12).alias("journal"))
    return socialnet.author_journal(CoordMatrix.of(docs, "o_custkey", "l_partkey"), labels).cells.select("row", "col", _r("value", 9))
