"""Queries of clustering, information, factorisation and learning over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import divergence, scalar
from ..matrix import CoordMatrix
from ..operators import active_nmf, bregman, cocluster, cocluster_moves, cocluster_signed, experiments, factor, fields, generative, information, kmeans, learn, validity
from ..session import cut
from . import inputs as I  # noqa: E741, N812

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


# Validity: labels of documents as classes, sources as clusters

_CM = "cm AS (SELECT lang AS cls, source AS cluster, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY cls) AS n_cls, sum(n) OVER (PARTITION BY cluster) AS n_cluster, sum(n) OVER () AS total FROM cm)"


def _confusion(spark, sf_dir):
    return validity.confusion(I.table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT lang AS cls, source AS cluster, count(*) AS n FROM documents GROUP BY 1, 2")
def cluster_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"WITH {_CM} SELECT round((SELECT sum(x)::DOUBLE / sum(s) FROM (SELECT max(n) AS x, sum(n) AS s FROM cm GROUP BY cluster)), 9) AS purity, round(sum(-n::DOUBLE / total * log2(n::DOUBLE / n_cluster)), 9) AS entropy, round((SELECT sum(f * k) / sum(k) FROM (SELECT max(2.0 * n / n_cluster * n / n_cls / (n::DOUBLE / n_cluster + n::DOUBLE / n_cls)) AS f, max(n_cls) AS k FROM m GROUP BY cls)), 9) AS f_measure FROM m")
def cluster_quality(spark, sf_dir):
    cm = _confusion(spark, sf_dir)
    return validity.purity(cm).crossJoin(validity.entropy(cm)).crossJoin(validity.f_measure(cm)).select(_r("purity", 9), _r("entropy", 9), _r("f_measure", 9))  # one row each


@query(f"WITH {_CM}, i AS (SELECT sum(n::DOUBLE / total * log2(n::DOUBLE * total / (n_cls * n_cluster))) AS mi FROM m), hx AS (SELECT sum(-k / t * log2(k / t)) AS hx FROM (SELECT sum(n)::DOUBLE AS k, (SELECT sum(n) FROM cm)::DOUBLE AS t FROM cm GROUP BY cls)), hy AS (SELECT sum(-k / t * log2(k / t)) AS hy FROM (SELECT sum(n)::DOUBLE AS k, (SELECT sum(n) FROM cm)::DOUBLE AS t FROM cm GROUP BY cluster)) SELECT round(mi, 9) AS mi, round(hx, 9) AS hx, round(hy, 9) AS hy, round(2 * mi / (hx + hy), 9) AS nmi_mean, round(mi / sqrt(hx * hy), 9) AS nmi_sqrt FROM i, hx, hy")
def cluster_information(spark, sf_dir):
    return validity.mutual_information(_confusion(spark, sf_dir)).select(*[_r(c, 9) for c in ("mi", "hx", "hy", "nmi_mean", "nmi_sqrt")])


@query("WITH cm AS (SELECT CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS cls, source AS cluster, count(*) AS n FROM documents GROUP BY 1, 2), b AS (SELECT cluster, max(n) AS n FROM cm GROUP BY 1) SELECT round((SELECT sum(n) FROM b)::DOUBLE / sum(n), 9) AS precision, round((SELECT sum(n) FROM b)::DOUBLE / sum(n), 9) AS recall FROM cm")
def cluster_micro_average(spark, sf_dir):
    code = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    cm = validity.confusion(I.table(spark, sf_dir, "documents").select(code.alias("cls"), "source"), "cls", "source")
    return validity.micro_precision_recall(cm).select(_r("precision", 9), _r("recall", 9))


# Information


@query(f"WITH {I.SAMPLES}, c AS (SELECT p.node AS a, q.node AS b, p.state AS s, q.state AS t, count(*)::DOUBLE AS n FROM samples p JOIN samples q ON p.sample = q.sample AND p.node < q.node GROUP BY 1, 2, 3, 4), m AS (SELECT *, sum(n) OVER (PARTITION BY a, b, s) AS ns, sum(n) OVER (PARTITION BY a, b, t) AS nt, sum(n) OVER (PARTITION BY a, b) AS total FROM c) SELECT a, b, round(sum(n / total * ln(n * total / (ns * nt))), 9) AS mi FROM m GROUP BY 1, 2")
def variable_information(spark, sf_dir):
    return information.mutual_information(I.observations(spark, sf_dir)).select("a", "b", _r("mi", 9))


@query(f"WITH {I.SAMPLES}, o AS (SELECT sample, node FROM samples WHERE state = 1) SELECT a.node AS a, b.node AS b, round(count(*) / (SELECT count(*) FROM s0)::DOUBLE, 9) AS p FROM o a JOIN o b ON a.sample = b.sample AND a.node <= b.node GROUP BY 1, 2")
def variable_co_occurrence(spark, sf_dir):
    return information.co_occurrence(I.observations(spark, sf_dir)).select("a", "b", _r("p", 9))


_MI = f"WITH RECURSIVE {I.SAMPLES}, c AS (SELECT p.node AS a, q.node AS b, p.state AS s, q.state AS t, count(*)::DOUBLE AS n FROM samples p JOIN samples q ON p.sample = q.sample AND p.node < q.node GROUP BY 1, 2, 3, 4), m AS (SELECT *, sum(n) OVER (PARTITION BY a, b, s) AS ns, sum(n) OVER (PARTITION BY a, b, t) AS nt, sum(n) OVER (PARTITION BY a, b) AS total FROM c), e AS (SELECT a::BIGINT AS row, b::BIGINT AS col, sum(n / total * ln(n * total / (ns * nt))) AS value FROM m GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY value DESC, row, col) AS k FROM e), walk(k, id) AS (SELECT k, row FROM o UNION SELECT w.k, CASE WHEN b.row = w.id THEN b.col ELSE b.row END FROM walk w JOIN o b ON b.k < w.k AND (b.row = w.id OR b.col = w.id))"


@query(f"{_MI} SELECT row, col, round(value, 6) AS value FROM o WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.k = o.k AND walk.id = o.col)")
def variable_tree(spark, sf_dir):
    return information.chow_liu(I.observations(spark, sf_dir), 4).select("row", "col", _r("value"))


@query(f"WITH {I.NATION_NET}, m AS (SELECT value, sum(value) OVER (PARTITION BY row) AS x, sum(value) OVER (PARTITION BY col) AS y, sum(value) OVER () AS t FROM nn) SELECT round(sum(value / t * log2(value * t / (x * y))), 9) AS mi FROM m")
def table_information(spark, sf_dir):
    return information.table_information(I.nation_net(spark, sf_dir)).select(_r("mi", 9))


# Divergences of points


@query(f"WITH {I.POINTS}, p AS (SELECT a.id, a.vec AS x, b.vec AS y FROM points a JOIN points b ON b.id = (a.id + 1) % (SELECT count(*) FROM points)) SELECT id, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * ln(z[1] / z[2]))), 9) AS kl, round(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS sq, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])), 9) AS dot FROM p")
def point_divergences(spark, sf_dir):
    p = I.points(spark, sf_dir).select("id", "vec")
    n = p.count()
    b = p.select(((F.col("id") - 1 + n) % n).alias("id"), F.col("vec").alias("y"))
    x, y = F.col("vec"), F.col("y")
    return p.join(b, "id").select("id", F.round(divergence.kl(x, y), 9).alias("kl"), F.round(divergence.squared_distance(x, y), 9).alias("sq"), F.round(divergence.dot(x, y), 9).alias("dot"))


@query(f"WITH {I.POINTS}, c AS (SELECT id % 3 AS cluster, i AS k, avg(vec[i]) AS v FROM points, range(1, 1 + (SELECT max(len(vec)) FROM points)) t(i) GROUP BY 1, 2), m AS (SELECT cluster, list(v ORDER BY k) AS mean FROM c GROUP BY 1), d AS (SELECT id, cluster::INT AS cluster, round(list_sum(list_transform(list_zip(vec, mean), lambda z: z[1] * ln(z[1] / z[2]))), 9) AS d FROM points, m) SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d GROUP BY 1".replace("arg_min(cluster, (d, cluster))", "arg_min(cluster, d * 1e6 + cluster * 1e-6)"))
def kmeans_step(spark, sf_dir):
    p = I.points(spark, sf_dir).select("id", "vec")
    labels = p.select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    return kmeans.nearest(p, kmeans.centroids(p, labels))


_ROUNDS = 6


def _kmeans_sql(k: int, rounds: int) -> str:
    """All rounds of k-means, and of them the last one before the stop."""
    parts = [f"l0 AS (SELECT id, (id % {k})::INT AS cluster FROM points)", "dims AS (SELECT i FROM range(1, 1 + (SELECT max(len(vec)) FROM points)) t(i))"]
    for r in range(1, rounds + 1):
        parts.append(f"m{r} AS MATERIALIZED (SELECT cluster, list(v ORDER BY i) AS mean FROM (SELECT cluster, i, avg(vec[i]) AS v FROM points JOIN l{r - 1} USING (id), dims GROUP BY 1, 2) GROUP BY 1)")
        parts.append(f"d{r} AS MATERIALIZED (SELECT id, cluster, round(list_sum(list_transform(list_zip(vec, mean), lambda z: z[1] * ln(z[1] / z[2]))), 9) AS d FROM points, m{r})")
        parts.append(f"l{r} AS MATERIALIZED (SELECT id, arg_min(cluster, d * 1e6 + cluster * 1e-6) AS cluster, min(d) AS d FROM d{r} GROUP BY 1)")
    objective = " UNION ALL ".join(f"SELECT {r} AS r, sum(d) AS f FROM l{r}" for r in range(1, rounds + 1))
    stop = f"stop AS (SELECT coalesce(min(b.r), {rounds}) AS r FROM obj a JOIN obj b ON b.r = a.r + 1 WHERE a.f - b.f <= 1e-3)"
    return f"WITH {I.POINTS}, {', '.join(parts)}, obj AS ({objective}), {stop} " + " UNION ALL ".join(f"SELECT id, cluster FROM l{r}, stop WHERE stop.r = {r}" for r in range(1, rounds + 1))


@query(_kmeans_sql(4, _ROUNDS))
def kmeans_clusters(spark, sf_dir):
    return kmeans.kmeans(I.points(spark, sf_dir).select("id", "vec"), 4, rounds=_ROUNDS)[0]


@query()
def single_link_clusters(spark, sf_dir):
    """All points; the tests hold it against a plain version."""
    return kmeans.single_link_of_points(I.points(spark, sf_dir).select("id", "vec"), 5)


@query()
def group_cluster_sizes(spark, sf_dir):
    return kmeans.cluster_sizes(cut(kmeans.group_clusters(I.user_group(spark, sf_dir), least=0.05)))


@query()
def group_clusters(spark, sf_dir):
    return kmeans.group_clusters(I.user_group(spark, sf_dir), least=0.05)


# Co-clustering of nations and part sizes

_Z = f"{I.USER_PART}, z AS (SELECT row, col, value, (row % 3)::INT AS g, (col % 4)::INT AS h FROM up)"
_MEANS = {"g": "g", "h": "h", "gh": "g, h", "r": "row", "c": "col", "rh": "row, h", "gc": "g, col"}


def _labels(spark):
    return bregman.initial_labels(spark.range(25), 3), bregman.initial_labels(spark.range(51), 4)


def _fit_sql(basis: int, kind: str) -> str:
    up, down = bregman.BASES[basis]
    m = lambda x: f"avg(value) OVER ({'PARTITION BY ' + _MEANS[x] if x in _MEANS else ''})"
    if kind == "i":
        return " * ".join(m(x) for x in up) + "".join(f" / {m(x)}" for x in down)
    return " + ".join(m(x) for x in up) + "".join(f" - {m(x)}" for x in down)


_OBJ = " UNION ALL ".join(f"SELECT {b} AS basis, '{k}' AS divergence, round(sum({'value * ln(value / f) - value + f' if k == 'i' else '(value - f) * (value - f)'}), 6) AS objective FROM (SELECT value, {_fit_sql(b, k)} AS f FROM z)" for b in bregman.BASES for k in ("i", "e"))


@query(f"WITH {_Z} {_OBJ}")
def bregman_objectives(spark, sf_dir):
    rows, cols = _labels(spark)
    return bregman.objectives(I.user_part(spark, sf_dir), rows, cols).select("basis", "divergence", _r("objective"))


@query(f"WITH {_Z}, b AS (SELECT g AS k, h, avg(value) AS mu FROM z GROUP BY 1, 2), d AS (SELECT row, k, round(sum((value - mu) * (value - mu)), 9) AS d FROM z JOIN b USING (h) GROUP BY 1, 2) SELECT row AS id, arg_min(k, d * 1e6 + k * 1e-6) AS cluster FROM d GROUP BY 1")
def bregman_step(spark, sf_dir):
    rows, cols = _labels(spark)
    return bregman.reassign(I.user_part(spark, sf_dir), rows, cols, 2, "e", 3)


@query()
def bregman_cocluster(spark, sf_dir):
    res = bregman.cocluster(I.user_part(spark, sf_dir), 3, 4, basis=2, divergence="i", rounds=4)
    return res.rows.select(F.lit("row").alias("side"), "id", "cluster").unionByName(res.cols.select(F.lit("col").alias("side"), "id", "cluster"))


@query()
def bregman_hierarchy(spark, sf_dir):
    res = bregman.hierarchical(I.user_part(spark, sf_dir), 2, basis=2, divergence="e", rounds=2)
    return res[-1].rows


@query(f"WITH {_Z}, t AS (SELECT * FROM z WHERE (row + col) % 5 <> 0), p AS (SELECT * FROM z WHERE (row + col) % 5 = 0), w AS (SELECT avg(value) AS w FROM t), gh AS (SELECT g, h, avg(value) AS m FROM t GROUP BY 1, 2), r AS (SELECT row, avg(value) AS m FROM t GROUP BY 1), c AS (SELECT col, avg(value) AS m FROM t GROUP BY 1), g AS (SELECT g, avg(value) AS m FROM t GROUP BY 1), h AS (SELECT h, avg(value) AS m FROM t GROUP BY 1) SELECT round(sqrt(avg(pow(value - (coalesce(gh.m, w) + coalesce(r.m, w) + coalesce(c.m, w) - coalesce(g.m, w) - coalesce(h.m, w)), 2))), 6) AS rmse FROM p CROSS JOIN w LEFT JOIN gh USING (g, h) LEFT JOIN r USING (row) LEFT JOIN c USING (col) LEFT JOIN g USING (g) LEFT JOIN h USING (h)")
def bregman_rmse(spark, sf_dir):
    m, (rows, cols) = I.user_part(spark, sf_dir), _labels(spark)
    part = lambda test: CoordMatrix(m.cells.filter(test), m.n_rows, m.n_cols)
    return bregman.rmse(part("(row + col) % 5 <> 0"), part("(row + col) % 5 = 0"), rows, cols, 5).select(_r("rmse"))


_NET = f"{I.NATION_NET}, z AS (SELECT row, col, value, (row % 3)::INT AS g, (col % 4)::INT AS h FROM nn)"


def _net_labels(spark):
    return bregman.initial_labels(spark.range(25), 3), bregman.initial_labels(spark.range(25), 4)


@query(f"WITH {_NET}, b AS (SELECT g, h, sum(value) AS s FROM z GROUP BY 1, 2), t AS (SELECT sum(value) AS t FROM z) SELECT round((SELECT sum(value / t * log2(value * t / (x * y))) FROM (SELECT value, sum(value) OVER (PARTITION BY row) AS x, sum(value) OVER (PARTITION BY col) AS y FROM z), t) - (SELECT sum(s / t * log2(s * t / (x * y))) FROM (SELECT s, sum(s) OVER (PARTITION BY g) AS x, sum(s) OVER (PARTITION BY h) AS y FROM b), t), 9) AS loss")
def itcc_loss(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster.information_loss(cocluster.joint(m), rows, cols).select(_r("loss", 9))


@query(f"WITH {_NET}, b AS (SELECT g AS k, h, sum(value) AS s FROM z GROUP BY 1, 2), q AS (SELECT k, h, s / sum(s) OVER (PARTITION BY k) AS q FROM b), v AS (SELECT row, h, g, sum(value) / sum(sum(value)) OVER (PARTITION BY row) AS v FROM z GROUP BY 1, 2, 3), d AS (SELECT row, g, k, round(sum(-v * ln(q)), 9) AS d FROM v JOIN q USING (h) GROUP BY 1, 2, 3) SELECT row AS id, arg_min(k, d * 1e6 + CASE WHEN k = g THEN 0 ELSE 1e-3 END + k * 1e-5) AS cluster FROM d GROUP BY 1")
def itcc_step(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster.itcc_rows(cocluster.joint(m), rows, cols)


@query(f"WITH {_NET}, nr AS (SELECT (i % 3)::INT AS g, count(*)::DOUBLE AS nr FROM range(25) t(i) GROUP BY 1), nc AS (SELECT (i % 4)::INT AS h, count(*)::DOUBLE AS nc FROM range(25) t(i) GROUP BY 1), full_ AS (SELECT a.i AS row, b.i AS col, (a.i % 3)::INT AS g, (b.i % 4)::INT AS h, coalesce(value, 0) AS value FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN nn ON row = a.i AND col = b.i), x AS (SELECT value, avg(value) OVER (PARTITION BY g, h) AS gh, avg(value) OVER (PARTITION BY row, h) AS r, avg(value) OVER (PARTITION BY col, g) AS c FROM full_) SELECT 1 AS kind, round(sum((value - gh) * (value - gh)), 4) AS residue FROM x UNION ALL SELECT 2, round(sum(pow(value - r - c + gh, 2)), 4) FROM x")
def mssr_residues(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    one = lambda k: cocluster.residue(m, rows, cols, k).select(F.lit(k).alias("kind"), _r("residue", 4))
    return one(1).unionByName(one(2))


@query(f"WITH {_NET}, full_ AS (SELECT a.i AS row, b.i AS col, (a.i % 3)::INT AS g, (b.i % 4)::INT AS h, coalesce(value, 0) AS value FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN nn ON row = a.i AND col = b.i), mu AS (SELECT g AS k, h, avg(value) AS mu FROM full_ GROUP BY 1, 2), d AS (SELECT row, g, k, sum(mu * mu - 2 * value * mu) AS d FROM full_ JOIN mu USING (h) GROUP BY 1, 2, 3) SELECT row AS id, arg_min(k, round(d, 6) + CASE WHEN k = g THEN 0 ELSE 1e-9 END) AS cluster FROM d GROUP BY 1")
def mssr_step(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster.mssr_rows(m, rows, cols)


def _plog(x: str) -> str:
    return f"(CASE WHEN {x} > 1e-15 THEN ({x}) * log2({x}) ELSE 0 END)"


@query(f"""WITH {_NET}, t AS (SELECT sum(value) AS t FROM z), k AS (SELECT i AS k, j AS h FROM range(3) a(i), range(4) b(j)), b AS (SELECT k.k, k.h, coalesce(sum(value), 0) / (SELECT t FROM t) AS s FROM k LEFT JOIN z ON z.g = k.k AND z.h = k.h GROUP BY 1, 2),
p AS (SELECT k, sum(s) AS p FROM b GROUP BY 1), r AS (SELECT i AS row, (i % 3)::INT AS g, j AS h, coalesce(sum(value), 0) / (SELECT t FROM t) AS v FROM range(25) a(i) CROSS JOIN range(4) c(j) LEFT JOIN z ON z.row = i AND z.h = j GROUP BY 1, 2, 3),
q AS (SELECT row, g, k, sum({_plog('s')} - CASE WHEN g = k THEN {_plog('(s - v)')} ELSE {_plog('(s + v)')} END) AS d, sum(v) AS own FROM r JOIN b USING (h) GROUP BY 1, 2, 3),
e AS (SELECT row, g, q.k, d - ({_plog('p')} - CASE WHEN g = q.k THEN {_plog('(p - own)')} ELSE {_plog('(p + own)')} END) AS d FROM q JOIN p USING (k))
SELECT a.row AS id, a.k AS cluster, round(a.d + l.d, 9) AS change FROM e a JOIN e l ON a.row = l.row AND l.k = l.g WHERE a.k <> a.g ORDER BY round(a.d + l.d, 9), a.row, a.k LIMIT 1""")
def itcc_move(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.best_row_move(cocluster.joint(m), rows, cols, kind="itcc").select("id", F.col("cluster").cast("bigint").alias("cluster"), _r("change", 9))


@query(f"""WITH {_NET}, full_ AS (SELECT a.i AS row, b.i AS col, (b.i % 4)::INT AS h, coalesce(value, 0) AS value FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN nn ON row = a.i AND col = b.i),
o AS (SELECT i AS id, k FROM range(25) a(i), range(3) b(k) WHERE k <> i % 3 UNION ALL SELECT -1, -1), l AS (SELECT id, k, row, col, h, value, CASE WHEN row = id THEN k ELSE row % 3 END AS g FROM o, full_),
x AS (SELECT id, k, value - avg(value) OVER (PARTITION BY id, k, row, h) - avg(value) OVER (PARTITION BY id, k, col, g) + avg(value) OVER (PARTITION BY id, k, g, h) AS e FROM l), f AS (SELECT id, k, sum(e * e) AS f FROM x GROUP BY 1, 2)
SELECT id::BIGINT AS id, k::BIGINT AS cluster, round(f - (SELECT f FROM f WHERE id = -1), 4) AS change FROM f WHERE id >= 0 ORDER BY 3, 1, 2 LIMIT 1""")
def mssr2_move(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.best_row_move(m, rows, cols, kind=2).select("id", F.col("cluster").cast("bigint").alias("cluster"), _r("change", 4))


def _moves_sql(steps: int, candidates: str, clusters: int = 3, digits: int = 6) -> str:
    """A chain of best moves: ``candidates`` gives id, k and change from labels l and the ids not to move, done; @ is the step."""
    parts, found = [f"l0 AS (SELECT i AS id, (i % {clusters})::INT AS g FROM range(25) a(i))", "m0 AS (SELECT -1 AS id)"], []
    for j in range(steps):
        done = " UNION ALL ".join(f"SELECT id FROM m{x}" for x in range(j + 1))
        parts.append(candidates.replace("@done", f"({done})").replace("@", str(j)))
        parts.append(f"m{j + 1} AS MATERIALIZED (SELECT id, k, change FROM c{j} ORDER BY round(change, 9), id, k LIMIT 1)")
        parts.append(f"l{j + 1} AS MATERIALIZED (SELECT l{j}.id, coalesce(k, g) AS g FROM l{j} LEFT JOIN m{j + 1} USING (id))")
        found.append(f"SELECT {j} AS step, id::BIGINT AS id, k::INT AS cluster, round(change, {digits}) AS change FROM m{j + 1}")
    return f"WITH {_NET}, {', '.join(parts)} {' UNION ALL '.join(found)}"


def _itcc_moves(row: str, col: str, rows: int, cols: int) -> str:
    return f"""t@ AS (SELECT sum(value) AS t FROM nn), z@ AS MATERIALIZED (SELECT {row} AS id, ({col} % {cols})::INT AS h, value / t AS value, g FROM nn JOIN l@ ON {row} = l@.id, t@),
b@ AS MATERIALIZED (SELECT a.k, b.h, coalesce(sum(value), 0) AS s FROM range({rows}) a(k) CROSS JOIN range({cols}) b(h) LEFT JOIN z@ ON z@.g = a.k AND z@.h = b.h GROUP BY 1, 2), p@ AS (SELECT k, sum(s) AS p FROM b@ GROUP BY 1),
r@ AS MATERIALIZED (SELECT l@.id, l@.g, b.h, coalesce(sum(value), 0) AS v FROM l@ CROSS JOIN range({cols}) b(h) LEFT JOIN z@ ON z@.id = l@.id AND z@.h = b.h GROUP BY 1, 2, 3),
q@ AS (SELECT id, g, k, sum({_plog('s')} - CASE WHEN g = k THEN {_plog('(s - v)')} ELSE {_plog('(s + v)')} END) AS d, sum(v) AS own FROM r@ JOIN b@ USING (h) GROUP BY 1, 2, 3),
e@ AS (SELECT id, g, q@.k, d - ({_plog('p')} - CASE WHEN g = q@.k THEN {_plog('(p - own)')} ELSE {_plog('(p + own)')} END) AS d FROM q@ JOIN p@ USING (k)),
c@ AS (SELECT a.id, a.k, a.d + o.d AS change FROM e@ a JOIN e@ o ON a.id = o.id AND o.k = o.g WHERE a.k <> a.g AND a.id NOT IN @done)"""


@query(_moves_sql(3, _itcc_moves("row", "col", 3, 4)))
def itcc_chain(spark, sf_dir):
    """Three best row moves one after the other, their changes from sums kept by deltas."""
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.chain(cocluster.joint(m), rows, cols, 3, kind="itcc").select("step", "id", "cluster", _r("change"))


@query(_moves_sql(2, _itcc_moves("col", "row", 4, 3), clusters=4))
def itcc_column_chain(spark, sf_dir):
    """Two best column moves."""
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.chain(cocluster.joint(m).transpose(), cols, rows, 2, kind="itcc").select("step", "id", "cluster", _r("change"))


_RESIDUE_MOVES = """o@ AS (SELECT l@.id, k, g FROM l@, range(3) b(k) WHERE k <> g AND id NOT IN @done UNION ALL SELECT -1, -1, -1),
y@ AS (SELECT o@.id, o@.k, a.id AS row, c.i AS col, (c.i % 4)::INT AS h, coalesce(value, 0) AS value, CASE WHEN a.id = o@.id THEN o@.k ELSE a.g END AS g FROM o@, l@ a CROSS JOIN range(25) c(i) LEFT JOIN nn ON nn.row = a.id AND nn.col = c.i),
x@ AS (SELECT id, k, value - avg(value) OVER (PARTITION BY id, k, row, h) - avg(value) OVER (PARTITION BY id, k, col, g) + avg(value) OVER (PARTITION BY id, k, g, h) AS e FROM y@), f@ AS (SELECT id, k, sum(e * e) AS f FROM x@ GROUP BY 1, 2),
c@ AS (SELECT id, k, f - (SELECT f FROM f@ WHERE id = -1) AS change FROM f@ WHERE id >= 0)"""


@query(_moves_sql(2, _RESIDUE_MOVES, digits=3))
def mssr2_chain(spark, sf_dir):
    """Two best row moves of residue II; the second reads the first one's deltas."""
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.chain(m, rows, cols, 2, kind=2).select("step", "id", "cluster", _r("change", 3))


# Reversed rows: the net without its mean, every third row reversed at the start

_SIGNED = f"{I.NATION_NET}, nz AS (SELECT row, col, value - (SELECT avg(value) FROM nn) AS value FROM nn), sf AS (SELECT a.i AS row, b.i AS col, (a.i % 3)::INT AS g, (b.i % 4)::INT AS h, CASE WHEN a.i % 2 = 1 THEN -1 ELSE 1 END AS s, coalesce(value, 0) * CASE WHEN a.i % 2 = 1 THEN -1 ELSE 1 END AS value FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN nz ON row = a.i AND col = b.i)"


def _signed_net(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    mean = m.cells.agg(F.avg("value").alias("mean"))
    cells = m.cells.crossJoin(mean).select("row", "col", (F.col("value") - F.col("mean")).alias("value"))  # one row
    return CoordMatrix(cells, m.n_rows, m.n_cols), rows.withColumn("sign", F.when(F.col("id") % 2 == 1, -1).otherwise(1)), cols


@query(f"WITH {_SIGNED} SELECT g, h, round(sum(value), 6) AS s FROM sf GROUP BY 1, 2")
def signed_block_sums(spark, sf_dir):
    return cocluster_signed.block_sums(*_signed_net(spark, sf_dir)).select("g", "h", _r("s"))


@query(f"WITH {_SIGNED}, x AS (SELECT value, avg(value) OVER (PARTITION BY g, h) AS gh, avg(value) OVER (PARTITION BY row, h) AS r, avg(value) OVER (PARTITION BY col, g) AS c FROM sf) SELECT 1 AS kind, round(sum((value - gh) * (value - gh)), 4) AS residue FROM x UNION ALL SELECT 2, round(sum(pow(value - r - c + gh, 2)), 4) FROM x")
def signed_residues(spark, sf_dir):
    m, rows, cols = _signed_net(spark, sf_dir)
    one = lambda k: cocluster_signed.residue(m, rows, cols, k).select(F.lit(k).alias("kind"), _r("residue", 4))
    return one(1).unionByName(one(2))


_SIGNED_PICK = "SELECT row AS id, k::INT AS cluster, (s * turn)::INT AS sign FROM d, (SELECT sum(value * value) AS q FROM nz) QUALIFY row_number() OVER (PARTITION BY row ORDER BY round(d / q, 9), k <> g OR turn = -1, k, turn DESC) = 1"


@query(f"WITH {_SIGNED}, mu AS (SELECT g AS k, h, avg(value) AS mu FROM sf GROUP BY 1, 2), d AS (SELECT row, g, s, k, turn, sum(mu * mu - 2 * turn * value * mu) AS d FROM sf JOIN mu USING (h), (VALUES (1), (-1)) t(turn) GROUP BY 1, 2, 3, 4, 5) {_SIGNED_PICK}")
def signed_step(spark, sf_dir):
    """Each row with the nearest cluster and sign under residue I."""
    return cocluster_signed.reassigned(*_signed_net(spark, sf_dir), kind=1)


@query(f"WITH {_SIGNED}, y AS (SELECT row, col, g, s, h, value, value - avg(value) OVER (PARTITION BY row, h) AS own FROM sf), mu AS (SELECT g AS k, col, avg(own) AS mu FROM y GROUP BY 1, 2), d AS (SELECT row, g, s, k, turn, sum(mu * mu - 2 * turn * own * mu) AS d FROM y JOIN mu USING (col), (VALUES (1), (-1)) t(turn) GROUP BY 1, 2, 3, 4, 5) {_SIGNED_PICK}")
def signed_step_2(spark, sf_dir):
    """The same under residue II."""
    return cocluster_signed.reassigned(*_signed_net(spark, sf_dir), kind=2)


@query()
def signed_clusters(spark, sf_dir):
    m, rows, cols = _signed_net(spark, sf_dir)
    res = cocluster_signed.mssr_signed(m, 3, 4, rounds=3, rows=rows, cols=cols)
    return res.rows.select(F.lit("row").alias("side"), "id", "cluster", "sign").unionByName(res.cols.select(F.lit("col").alias("side"), "id", "cluster", F.lit(1).alias("sign")))


@query()
def itcc_farthest_start(spark, sf_dir):
    return cocluster.farthest_start(cocluster.joint(I.nation_net(spark, sf_dir)), 3)


@query()
def itcc_local_search(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.local_search(cocluster.joint(m), rows, cols, 3, kind="itcc")[0]


@query()
def itcc_clusters(spark, sf_dir):
    return cocluster.itcc(I.nation_net(spark, sf_dir), 3, 3, rounds=3).rows


@query()
def mssr_clusters(spark, sf_dir):
    return cocluster.mssr(I.nation_net(spark, sf_dir), 3, 3, kind=2, rounds=3, schedule=cocluster.Schedule.SIMULTANEOUS).rows


@query()
def mssr_local_search(spark, sf_dir):
    m, (rows, cols) = I.nation_net(spark, sf_dir), _net_labels(spark)
    return cocluster_moves.local_search(m, rows, cols, 3)[0]


# Factors


@query()
def svd_values(spark, sf_dir):
    _, s, _ = factor.svd(I.nation_net(spark, sf_dir), 3)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(s)], "k int, value double")


@query()
def svd_scores(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    u, s, v = factor.svd(m, 3)
    return factor.factor_scores(m.cells, u, v, s).select("row", "col", _r("value", 4))


@query()
def eigen_values(spark, sf_dir):
    w, _ = factor.symmetric_eigen(I.nation_net(spark, sf_dir, sparse=True), 3)
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate(w)], "k int, value double")


@query()
def nmf_factors(spark, sf_dir):
    b, _, _ = factor.nmf(I.nation_net(spark, sf_dir), 3, rounds=4)
    return b.select("id", F.transform("vec", lambda v: F.round(v, 5)).alias("vec"))


@query()
def nmf_kl_factors(spark, sf_dir):
    b, _, _ = factor.nmf(I.nation_net(spark, sf_dir), 3, rounds=3, divergence="kl")
    return b.select("id", F.transform("vec", lambda v: F.round(v, 5)).alias("vec"))


_START = "(((id + 1) * (7919 + 104729 * (c + 1)) + id * id * (31 + c)) % 1000003) / 1000003.0 + 0.1"


@query(f"WITH {I.NATION_NET}, f AS (SELECT id, c, {_START} AS v FROM range(25) a(id), range(3) b(c)), g AS (SELECT x.c AS p, y.c AS q, sum(x.v * y.v) AS g FROM f x JOIN f y USING (id) GROUP BY 1, 2), t AS (SELECT row AS id, c, sum(value * v) AS t FROM nn JOIN f ON f.id = col GROUP BY 1, 2), s AS (SELECT f.id, q AS c, sum(f.v * g) AS s FROM f JOIN g ON g.p = f.c GROUP BY 1, 2) SELECT f.id::BIGINT AS id, round(sqrt(sum(pow(least(f.v, s - coalesce(t, 0)), 2))), 5) AS residual FROM f JOIN s USING (id, c) LEFT JOIN t USING (id, c) GROUP BY 1")
def nmf_residuals(spark, sf_dir):
    """How far the rows of the start are from their optimum."""
    m = I.nation_net(spark, sf_dir)
    return active_nmf.residuals(m, factor.nonnegative_start(m, 3, "row"), factor.nonnegative_start(m, 3, "col"), 3).select("id", _r("residual", 5))


@query("SELECT i::BIGINT AS id, true AS optimal FROM range(25) a(i)")
def nmf_active_optimal(spark, sf_dir):
    """Every row after exact active-set steps: its residual is nothing beside the one it had."""
    m = I.nation_net(spark, sf_dir)
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    b, c = factor.nonnegative_start(m, 3, "row"), factor.nonnegative_start(m, 3, "col")
    before = active_nmf.residuals(m, b, c, 3).withColumnRenamed("residual", "before")
    after = active_nmf.residuals(m, active_nmf.updated(m, b, c, 3, exact=True), c, 3)
    return after.join(before, "id").select("id", (F.col("residual") <= 1e-8 * (1 + F.col("before"))).alias("optimal"))


@query()
def nmf_active_factors(spark, sf_dir):
    b, _, _ = active_nmf.active_set_nmf(I.nation_net(spark, sf_dir), 3, rounds=3)
    return b.select("id", F.transform("vec", lambda v: F.round(v, 4)).alias("vec"))


@query()
def nmf_masked(spark, sf_dir):
    b, _, _ = factor.masked_nmf(I.user_part(spark, sf_dir), 2, rounds=3)
    return b.select("id", F.transform("vec", lambda v: F.round(v, 5)).alias("vec"))


@query()
def svp_completion(spark, sf_dir):
    m = I.nation_net(spark, sf_dir)
    unknown = m.cells.filter("(row * 7 + col) % 11 = 0").select("row", "col")
    return factor.singular_value_projection(m, unknown, 2, rounds=2).cells.select("row", "col", _r("value", 4))


@query()
def parafac_factors(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).alias("i"), F.col("l_linenumber").cast("bigint").alias("j"), (F.col("l_quantity") % 5).cast("bigint").alias("k"))
    cells = lines.groupBy("i", "j", "k").agg(F.count("*").cast("double").alias("value"))
    factors, _ = factor.parafac(cells, (6, 8, 5), 2, rounds=2)
    return factors["i"].select("id", F.transform("vec", lambda v: F.round(v, 5)).alias("vec"))


@query()
def katz_learned_weights(spark, sf_dir):
    from ..operators.katz import walk_powers

    m = I.nation_net(spark, sf_dir, sparse=True)
    w = factor.power_weights(walk_powers(m, 3), I.nation_net(spark, sf_dir), ridge=1.0)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(w, 1)], "power int, weight double")


# Learning


def _regression(spark, sf_dir):
    d, lab = I.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), I.table(spark, sf_dir, "labels").select("doc_id", "quality")
    signs = (F.length(F.regexp_replace("text", "[^!%$#&*|]", "")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("signs")
    return d.join(lab, "doc_id").select("doc_id", signs, (F.log1p("n_chars") / 10).alias("size"), F.col("quality").cast("double").alias("y"))


@query("WITH x AS (SELECT doc_id, length(regexp_replace(text, '[^!%$#&*|]', '', 'g'))::DOUBLE / greatest(n_chars, 1) AS signs, ln(1 + n_chars) / 10 AS size, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)), m AS (SELECT *, 0.5 - 2 * signs + 0.25 * size AS m FROM x) SELECT round(avg(greatest(m, 0) + ln(1 + exp(-abs(m))) - y * m), 9) AS loss, round(avg(1 / (1 + exp(-m)) - y), 9) AS g0, round(avg((1 / (1 + exp(-m)) - y) * signs), 9) AS g1, round(avg((1 / (1 + exp(-m)) - y) * size), 9) AS g2 FROM m")
def logistic_gradient(spark, sf_dir):
    f, g = learn.logistic_loss(_regression(spark, sf_dir), ["signs", "size"], "y", np.array([0.5, -2.0, 0.25]))
    return spark.createDataFrame([tuple(round(float(v), 9) for v in (f, *g))], "loss double, g0 double, g1 double, g2 double")


@query()
def logistic_l1_weights(spark, sf_dir):
    beta = learn.logistic_l1(_regression(spark, sf_dir), ["signs", "size"], "y", 0.001, rounds=25)
    return spark.createDataFrame([(i, round(float(b), 5)) for i, b in enumerate(beta)], "i int, weight double")


@query("SELECT doc_id, CASE WHEN 0.5 - 2 * (length(regexp_replace(text, '[^!%$#&*|]', '', 'g'))::DOUBLE / greatest(n_chars, 1)) + 0.25 * (ln(1 + n_chars) / 10) >= 0 THEN 1 ELSE -1 END AS label FROM documents JOIN labels USING (doc_id)")
def logistic_labels(spark, sf_dir):
    df = _regression(spark, sf_dir)
    return df.select("doc_id", learn.classify(["signs", "size"], np.array([0.5, -2.0, 0.25])).alias("label"))


def _binary(spark, sf_dir):
    """All four variables, read as binary: state 0 or another."""
    return I.observations(spark, sf_dir).select(F.transform("x", lambda v: (v > 0).cast("int")).alias("x"))


@query()
def group_lasso_weights(spark, sf_dir):
    w = learn.wide(I.observations(spark, sf_dir), 4).select(*[F.col(f"n{i}") for i in (1, 2, 3)], F.col("n0").cast("int").alias("y"))
    b = learn.group_lasso(w, ["n1", "n2", "n3"], "y", 3, [[0], [1], [2]], 0.01, rounds=15)
    return spark.createDataFrame([(c, i, round(float(b[c, i]), 5)) for c in range(b.shape[0]) for i in range(b.shape[1])], "class int, i int, weight double")


@query()
def ising_couplings(spark, sf_dir):
    s = _binary(spark, sf_dir)
    j = learn.ising(s, 4, 0.001, rounds=15)
    return spark.createDataFrame([(a, b, round(float(j[a, b]), 5)) for a in range(4) for b in range(a + 1, 4)], "a int, b int, coupling double")


def _chain(coupling: float, n: int) -> np.ndarray:
    return coupling * (np.eye(n, k=1) + np.eye(n, k=-1))


_X = "x AS (SELECT CASE WHEN a > 0 THEN 1 ELSE -1 END AS a, CASE WHEN b > 0 THEN 1 ELSE -1 END AS b, CASE WHEN c > 0 THEN 1 ELSE -1 END AS c, CASE WHEN d > 0 THEN 1 ELSE -1 END AS d, sample FROM s0)"


@query(f"WITH {I.SAMPLES}, {_X} SELECT round(avg(ln(1 + exp(-2 * a * (0.1 + 0.2 * b))) + ln(1 + exp(-2 * b * (0.1 + 0.2 * (a + c)))) + ln(1 + exp(-2 * c * (0.1 + 0.2 * (b + d)))) + ln(1 + exp(-2 * d * (0.1 + 0.2 * c)))), 9) AS loss FROM x")
def ising_pseudo_likelihood(spark, sf_dir):
    s = _binary(spark, sf_dir)
    return learn.pseudo_likelihood(s, _chain(0.2, 4), np.full(4, 0.1)).select(_r("loss", 9))


# Fields of three states on a chain of four variables


def _field() -> fields.Field:
    blocks = {}
    for a in range(3):
        b = np.zeros((3, 3))
        b[:2, :2] = 0.3 * np.outer([1, 2], [1, 2]) / (2 * a + 2)
        blocks[a, a + 1] = b
    return fields.Field(np.array([[0.1 * (s - i) for s in range(3)] for i in range(4)]), blocks)


_FIELD = f"""{I.THREE_STATES}, own AS (SELECT node, s, 0.1 * (s - node) AS e FROM range(4) a(node), range(3) b(s)), blk AS (SELECT a, a + 1 AS b, s, t, CASE WHEN s < 2 AND t < 2 THEN 0.3 * ((s + 1) * (t + 1)) / (2 * a + 2) ELSE 0 END AS e FROM range(3) g(a), range(3) q(s), range(3) w(t)),
seen AS (SELECT a AS node, b AS o, s, t, e FROM blk UNION ALL SELECT b, a, t, s, e FROM blk)"""
_CONDITIONALS = f"""{_FIELD}, u AS (SELECT concat_ws(',', a, b, c, d) AS x, a, b, c, d, count(*) AS n FROM s3 GROUP BY ALL), v AS (SELECT x, n, unnest([0, 1, 2, 3]) AS node, unnest([a, b, c, d]) AS state FROM u),
sc AS (SELECT v.x, v.n, v.node, v.state, own.s, own.e + sum(seen.e) AS e FROM v JOIN own USING (node) JOIN seen ON seen.node = v.node AND seen.s = own.s JOIN v w ON w.x = v.x AND w.node = seen.o AND w.state = seen.t GROUP BY 1, 2, 3, 4, 5, own.e), pr AS (SELECT *, exp(e) / sum(exp(e)) OVER (PARTITION BY x, node) AS p FROM sc)"""


@query(f"WITH {_CONDITIONALS} SELECT x, n, node, s AS state, round(p, 9) AS p FROM pr")
def field_conditionals(spark, sf_dir):
    rows = fields.conditionals(I.three_states(spark, sf_dir), _field())
    each = rows.select(F.array_join("x", ",").alias("x"), "n", F.posexplode("p").alias("node", "q"))
    return each.select("x", "n", "node", F.posexplode("q").alias("state", "p")).select("x", "n", "node", "state", _r("p", 9))


@query(f"WITH {_CONDITIONALS} SELECT round(4 * sum(-ln(p) * n) / sum(n), 9) AS loss FROM pr WHERE s = state")
def field_pseudo_likelihood(spark, sf_dir):
    return fields.pseudo_likelihood(I.three_states(spark, sf_dir), _field()).select(_r("loss", 9))


def _class_sql(before: str, after: str, members: str) -> str:
    """One colour class drawn: the running sum of probabilities against a number from MD5."""
    return f"""{after}p AS (SELECT v.r, v.key, v.node, own.s, exp(own.e + sum(seen.e)) AS e FROM {before} v JOIN own USING (node) JOIN seen ON seen.node = v.node AND seen.s = own.s JOIN {before} w ON w.r = v.r AND w.node = seen.o AND w.state = seen.t WHERE v.node IN ({members}) GROUP BY 1, 2, 3, 4, own.e),
{after}c AS (SELECT *, sum(e) OVER (PARTITION BY r, node ORDER BY s) / sum(e) OVER (PARTITION BY r, node) AS cum, ('0x' || substr(md5(concat_ws(',', 1, 0, key, node)), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM {after}p),
{after} AS MATERIALIZED (SELECT r, key, node, state FROM {before} WHERE node NOT IN ({members}) UNION ALL SELECT r, key, node, least(count(*) FILTER (cum <= u), 2)::INT FROM {after}c GROUP BY 1, 2, 3)"""


@query(f"WITH {_FIELD}, g0 AS MATERIALIZED (SELECT r, key, unnest([0, 1, 2, 3]) AS node, unnest([a, b, c, d]) AS state FROM s3), {_class_sql('g0', 'g1', '0, 2')}, {_class_sql('g1', 'g2', '1, 3')} SELECT p.node AS a, q.node AS b, p.state AS s, q.state AS t, count(*) AS n FROM g2 p JOIN g2 q ON p.r = q.r AND p.node < q.node GROUP BY 1, 2, 3, 4")
def field_gibbs_sweep(spark, sf_dir):
    """Joint states of all pairs after one sweep from the order lines."""
    return information.pair_counts(fields.gibbs(I.three_states(spark, sf_dir), _field(), 1))


@query(f"WITH {_CONDITIONALS}, f AS (SELECT x, node AS other, state AS other_state FROM v WHERE state < 2 UNION ALL SELECT DISTINCT x, -1, 0 FROM v) SELECT pr.node, s AS state, other, other_state, round(sum(n * (p - CASE WHEN s = state THEN 1 ELSE 0 END)), 6) AS g FROM pr JOIN f ON f.x = pr.x AND f.other <> pr.node WHERE s < 2 GROUP BY 1, 2, 3, 4")
def field_gradient(spark, sf_dir):
    """The gradients of all variables' regressions in one pass, at the chain's parameters; other -1: the intercept."""
    f = _field()
    w = np.zeros((9, 8))
    for i in range(4):
        w[0, 2 * i : 2 * i + 2] = f.own[i, :2] - f.own[i, 2]
        for j in f.neighbours(i):
            w[1 + 2 * j : 3 + 2 * j, 2 * i : 2 * i + 2] = f.block(i, j)[:2, :2].T
    counted = I.three_states(spark, sf_dir).groupBy("x").agg(F.count("*").alias("n"))
    sums = fields.neighbourhood_sums(counted, w, 4, 3).filter("i >= 0")
    named = sums.select(F.floor(F.col("j") / 2).cast("int").alias("node"), (F.col("j") % 2).alias("state"), F.when(F.col("i") == 0, -1).otherwise(F.floor((F.col("i") - 1) / 2)).cast("int").alias("other"), F.when(F.col("i") == 0, 0).otherwise((F.col("i") - 1) % 2).alias("other_state"), _r("v").alias("g"))
    return named.filter("node <> other")


@query()
def field_path(spark, sf_dir):
    """Norms of the couplings that each variable's regression gives to each other one, for three penalties."""
    steps = fields.neighbourhood_path(I.three_states(spark, sf_dir), 4, 3, [0.02, 0.005, 0.001], rounds=40)
    rows = [(s.penalty, i, j, round(float(fields.block_norms(s, 4, 3)[j, i]), 4)) for s in steps for i in range(4) for j in range(4) if i != j]
    return spark.createDataFrame(rows, "penalty double, node int, other int, norm double")


# Trees by class: whether a line is large (the third variable's upper state) from the other three


def _by_size(spark, sf_dir):
    return I.three_states(spark, sf_dir).select("key", F.array(*[F.col("x")[k] for k in (0, 1, 3)]).alias("x"), (F.col("x")[2] == 2).cast("int").alias("y"))


_TREE = f"""{I.THREE_STATES}, o AS (SELECT (c = 2)::INT AS y, a, b, d, count(*) AS n FROM s3 GROUP BY ALL), ys AS (SELECT y, sum(n) AS n FROM o GROUP BY 1),
ra AS (SELECT y, s, ln((coalesce(sum(n) FILTER (a = s), 0) + 1) / (sum(n) + 3)) AS l FROM o, range(3) t(s) GROUP BY 1, 2),
rb AS (SELECT y, p, s, ln((coalesce(sum(n) FILTER (a = p AND b = s), 0) + 1) / (coalesce(sum(n) FILTER (a = p), 0) + 3)) AS l FROM o, range(3) u(p), range(3) t(s) GROUP BY 1, 2, 3),
rd AS (SELECT y, p, s, ln((coalesce(sum(n) FILTER (b = p AND d = s), 0) + 1) / (coalesce(sum(n) FILTER (b = p), 0) + 3)) AS l FROM o, range(3) u(p), range(3) t(s) GROUP BY 1, 2, 3),
x AS (SELECT DISTINCT a, b, d FROM o), lp AS (SELECT x.a, x.b, x.d, ys.y, ln(ys.n / (SELECT sum(n) FROM ys)) + ra.l + rb.l + rd.l AS l FROM x, ys JOIN ra ON ra.y = ys.y AND ra.s = x.a JOIN rb ON rb.y = ys.y AND rb.p = x.a AND rb.s = x.b JOIN rd ON rd.y = ys.y AND rd.p = x.b AND rd.s = x.d)"""


@query(f"WITH {_TREE} SELECT concat_ws(',', a, b, d) AS x, round(sum(CASE WHEN y = 1 THEN l ELSE -l END), 9) AS log_odds FROM lp GROUP BY a, b, d")
def tree_log_odds(spark, sf_dir):
    """Log-odds of a large line under trees of given shape, by distinct observation."""
    df = _by_size(spark, sf_dir)
    model = generative.fit_trees(df, 3, 3, parents=[-1, 0, 1])
    return df.select("x").distinct().select(F.array_join("x", ",").alias("x"), F.round(model.log_odds(), 9).alias("log_odds"))


@query(f"WITH {_TREE}, best AS (SELECT a, b, d, y FROM lp QUALIFY row_number() OVER (PARTITION BY a, b, d ORDER BY round(l, 12) DESC, y) = 1) SELECT round(sum(n) FILTER (o.y <> best.y) / sum(n), 9) AS error FROM o JOIN best USING (a, b, d)")
def tree_error(spark, sf_dir):
    """The share of lines whose class these trees miss."""
    df = _by_size(spark, sf_dir)
    model = generative.fit_trees(df, 3, 3, parents=[-1, 0, 1])
    return spark.createDataFrame([(round(generative.misclassified(df, model.predicted()), 9),)], "error double")


@query()
def classifier_curves(spark, sf_dir):
    """Errors of trees and of logistic regression by sample size, on lines whose key's hash is even."""
    df = _by_size(spark, sf_dir)
    even = F.xxhash64("key") % 2 == 0
    out = generative.learning_curves(df.filter(~even), df.filter(even), 3, 3, [100, 400, 1600], trials=3)
    return out.select("size", _r("generative"), _r("discriminative"))


@query()
def recovery_trials(spark, sf_dir):
    """How often the edges found in samples of the lines are those found in all of them."""
    df = I.three_states(spark, sf_dir)
    whole = fields.block_norms(fields.neighbourhood_path(df, 4, 3, [0.01], rounds=40)[0], 4, 3)
    truth = {(a, b) for a in range(4) for b in range(a + 1, 4) if max(whole[a, b], whole[b, a]) > 0.05}
    edges = generative.trial_edges(df, 4, 3, [200, 800], [0.05, 0.01], trials=3, rounds=60)
    return generative.success_curve(edges, truth).select("size", "penalty", _r("success"), _r("differing"))


_NET_FIELD = f"{I.NATION_SPARSE}, st AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS chain, c_nationkey::BIGINT AS node, (count(*) % 3)::INT AS state FROM customer GROUP BY 1, 2)"


def _net_field(spark, sf_dir):
    """States of nations by market segment, and a field on the sparse net that likes equal neighbours."""
    segment = F.lit(4)
    for k, name in enumerate(("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")):
        segment = F.when(F.col("c_mktsegment") == name, k).otherwise(segment)
    states = I.table(spark, sf_dir, "customer").groupBy(segment.alias("chain"), F.col("c_nationkey").cast("bigint").alias("node")).agg((F.count("*") % 3).cast("int").alias("state"))
    own = spark.range(25).select(F.col("id").alias("node"), F.array(F.lit(0.0), F.lit(0.1), F.lit(0.2)).alias("own"))
    block = F.array(*[F.lit(0.2 if s == t else 0.0) for s in range(3) for t in range(3)])
    edges = I.nation_net(spark, sf_dir, sparse=True).upper(diagonal=False).cells.select(F.col("row").alias("a"), F.col("col").alias("b"), block.alias("block"))
    return states, fields.FieldTables(own, edges, 3)


@query(f"WITH {_NET_FIELD}, e AS (SELECT a.chain, a.node, s, 0.1 * s + 0.2 * count(b.node) AS e FROM st a CROSS JOIN range(3) t(s) LEFT JOIN ns ON ns.row = a.node AND ns.row <> ns.col LEFT JOIN st b ON b.chain = a.chain AND b.node = ns.col AND b.state = s GROUP BY 1, 2, 3) SELECT chain, node, s AS state, round(exp(e) / sum(exp(e)) OVER (PARTITION BY chain, node), 9) AS p FROM e")
def net_conditionals(spark, sf_dir):
    states, f = _net_field(spark, sf_dir)
    return fields.table_conditionals(states, f).select("chain", "node", F.posexplode("p").alias("state", "p")).select("chain", "node", "state", _r("p", 9))


@query()
def net_gibbs(spark, sf_dir):
    """States after two sweeps by colour classes of the net."""
    states, f = _net_field(spark, sf_dir)
    f = fields.FieldTables(f.own, cut(f.couplings), 3)
    return fields.table_gibbs(cut(states), f, fields.colouring(f.couplings, f.own), 2)


# Functions


@query("SELECT event_id, array_to_string(list_filter(regexp_split_to_array(props, '[,:{}\" ]'), lambda x: x <> ''), '|') AS words, contains(lower(props), lower(event_type)) OR contains(lower(event_type), lower(props)) AS inside, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def text_functions(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(scalar.words(F.col("props"), ',:{}" '), "|").alias("words"), scalar.is_substring(F.col("props"), F.col("event_type")).alias("inside"), scalar.time_stamp(F.col("ts")).alias("stamp"))


@query("WITH d(lo, hi) AS (VALUES (1000.0, 50000.0), (60000.0, 120000.0), (150000.0, 150000.0)), x AS (SELECT DISTINCT round(o_totalprice, 0)::DOUBLE AS x FROM orders) SELECT x, coalesce(max(CASE WHEN lo <= x AND x <= hi THEN x END), max(CASE WHEN hi <= x THEN hi END), '-infinity'::DOUBLE)::DOUBLE AS floor, coalesce(max(CASE WHEN lo <= x AND x <= hi THEN x END), min(CASE WHEN lo >= x THEN lo END), 'infinity'::DOUBLE)::DOUBLE AS ceiling FROM x, d GROUP BY 1")
def interval_lookup(spark, sf_dir):
    points = I.table(spark, sf_dir, "orders").select(F.round("o_totalprice", 0).alias("x")).distinct()
    domain = spark.createDataFrame([(1000.0, 50000.0), (60000.0, 120000.0), (150000.0, 150000.0)], "lo double, hi double")
    return scalar.interval_lookup(points, domain)


@query("SELECT p_partkey, (floor(round(ln(p_retailprice) / ln(4), 12)) + 1)::BIGINT AS m, round(p_retailprice / pow(4.0, (floor(round(ln(p_retailprice) / ln(4), 12)) + 1)), 9) AS r FROM part")
def quarter_form(spark, sf_dir):
    m, r = scalar.quarter_form(F.col("p_retailprice"))
    return I.table(spark, sf_dir, "part").select("p_partkey", m.cast("bigint").alias("m"), F.round(r, 9).alias("r"))


# Experiments


_HARNESS = f"""{I.USER_GROUP}, s AS (SELECT row, col, row_number() OVER (PARTITION BY row ORDER BY (row * 7919 + col * 104729) % 1000003, row, col) <= floor(0.7 * count(*) OVER (PARTITION BY row)) AS kept FROM ug),
tr AS (SELECT row, col FROM s WHERE kept), ta AS (SELECT row, col FROM s WHERE NOT kept),
aa AS (SELECT a.col AS c1, b.col AS c2, count(*)::DOUBLE AS v FROM tr a JOIN tr b ON a.row = b.row GROUP BY 1, 2),
hop AS (SELECT tr.row, aa.c2 AS col, sum(aa.v) AS score FROM tr JOIN aa ON tr.col = aa.c1 GROUP BY 1, 2),
grid AS (SELECT u.row, g.col FROM (SELECT DISTINCT row FROM ta) u, (SELECT i AS col FROM range((SELECT max(s_suppkey) + 1 FROM supplier)) t(i)) g),
x AS (SELECT grid.row, coalesce(score, 0) AS score, CASE WHEN ta.row IS NULL THEN 0 ELSE 1 END AS target FROM grid ANTI JOIN tr USING (row, col) LEFT JOIN hop USING (row, col) LEFT JOIN ta USING (row, col)),
b AS (SELECT row, score, count(*) AS n, sum(target) AS t FROM x GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(n) OVER w, 0) AS above, coalesce(sum(t) OVER w, 0) AS t_above, sum(n) OVER (PARTITION BY row) AS all_n, sum(t) OVER (PARTITION BY row) AS all_t FROM b WINDOW w AS (PARTITION BY row ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT n_top, t_above + t * (n_top - above)::DOUBLE / n AS hits, all_n, all_t FROM c JOIN (VALUES (5), (10), (20)) k(n_top) ON above < n_top AND n_top <= above + n)"""


@query(f"WITH {_HARNESS} SELECT n_top, round(avg(hits / n_top), 9) AS precision, round(avg(hits / all_t), 9) AS sensitivity, round(avg(1 - (n_top - hits) / (all_n - all_t)), 9) AS specificity, count(*) AS users FROM e GROUP BY 1")
def recommendation_harness(spark, sf_dir):
    splits = experiments.split_memberships(I.user_group(spark, sf_dir), 0.3, 0.1)
    out = experiments.evaluate_predictor(I.user_user(spark, sf_dir), splits, experiments.PREDICTORS["two_hop"], [5, 10, 20])
    return out.select("n_top", _r("precision", 9), _r("sensitivity", 9), _r("specificity", 9), "users")


@query()
def recommendation_by_svd(spark, sf_dir):
    splits = experiments.split_memberships(I.user_group(spark, sf_dir).stored(), 0.3, 0.1).stored()
    out = experiments.evaluate_predictor(I.user_user(spark, sf_dir), splits, experiments.svd_predictor(4), [5, 10])
    return out.select("n_top", _r("precision", 4), _r("sensitivity", 4), "users")


def _four_digits(name: str):
    """Rounded half up as by round(), in floating point: that one goes through decimals, which is felt in billions of cells."""
    v = F.col(name)
    return (F.signum(v) * F.floor(F.abs(v) * 1e4 + 0.5) / 1e4 + 0.0).alias(name)


@query()
def recommendation_by_clusters(spark, sf_dir):
    ug = I.user_group(spark, sf_dir)
    part = lambda n: spark.range(n).select("id", (F.col("id") % 4).cast("int").alias("cluster"))
    return experiments.clustered_svd_scores(ug, part(ug.n_rows), part(ug.n_cols), 3).cells.select("row", "col", _four_digits("value"))


@query()
def trifactor_roles(spark, sf_dir):
    p, _, _ = factor.symmetric_trifactor([I.nation_net(spark, sf_dir, sparse=True)], 2, rounds=3)
    return p.select("id", F.transform("vec", lambda v: F.round(v, 5)).alias("vec"))


@query()
def tucker_factors(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).alias("i"), F.col("l_linenumber").cast("bigint").alias("j"), (F.col("l_quantity") % 5).cast("bigint").alias("k"))
    cells = lines.groupBy("i", "j", "k").agg(F.count("*").cast("double").alias("value"))
    factors, _, _ = factor.tucker(cells, (6, 8, 5), (2, 2, 2), rounds=2)
    return factors["i"].select("id", F.transform("vec", lambda v: F.round(v, 5)).alias("vec"))


@query()
def nuclear_completion(spark, sf_dir):
    m = I.user_part(spark, sf_dir)
    u, s, v = factor.nuclear_completion(m, 2, 1.0, rounds=2)
    return factor.factor_scores(m.cells, u, v, s).select("row", "col", _r("value", 3))
