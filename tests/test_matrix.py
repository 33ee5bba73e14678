import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.matrix import CliqueMatrix, CoordMatrix, value_ranks
from gridloom.operators import bregman, cocluster, cocluster_moves, factor, graph, katz, ranking, rowwise


def dense(m):
    a = np.zeros((m.n_rows, m.n_cols))
    for r in m.cells.collect():
        a[r["row"], r["col"]] += r["value"]
    return a


def sparse(spark, a):
    return CoordMatrix.from_rows(spark, [(i, j, a[i, j]) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]], a.shape)


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(1).integers(0, 4, (7, 5)).astype(float)


def test_algebra(spark, a):
    m = sparse(spark, a)
    assert np.allclose(dense(m.transpose().multiply(m)), a.T @ a)
    assert np.allclose(dense(m.add(m, -3)), -2 * a)
    assert np.allclose(dense(m.hadamard(m)), a * a)
    assert np.isclose(m.norm().first()[0], np.linalg.norm(a))
    assert np.allclose(dense(m.block_with(m, below=True)), np.vstack([a, a]))
    with pytest.raises(ValueError):
        m.multiply(m)


def test_duplicates_add_up(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (2, 0, 1.0)], "row long, col long, value double")
    m = CoordMatrix.of(df, "row", "col", "value")
    assert (m.n_rows, m.n_cols) == (3, 2)
    assert dense(m)[0, 1] == 5


def test_katz(spark):
    b = np.zeros((6, 6))
    for i in range(5):
        b[i, i + 1] = b[i + 1, i] = 1
    m = sparse(spark, b)
    want = sum((0.1**i) * np.linalg.matrix_power(b, i) for i in range(1, 6))
    assert np.allclose(dense(katz.truncated(m, 5, 0.1)), want)
    assert np.allclose(dense(katz.truncated(m, 5, 0.1, first_term_only=True)), 0.1 * b)
    assert np.allclose(katz.exact(m, 0.1), np.linalg.solve(np.eye(6) - 0.1 * b, 0.1 * b))


def test_tied_metrics(spark):
    # ten equal scores, three targets, n = 3: every order is as likely
    items = spark.createDataFrame([(i, 0.0, int(i in (2, 3, 7))) for i in range(10)], "item long, score double, target int")
    r = ranking.evaluate(items, [3]).first()
    assert np.isclose(r["sensitivity"], 0.3)
    assert np.isclose(r["specificity"], 0.7)


@pytest.mark.parametrize("above,want", [((), 0.5), ((5,), 1.0), ((5, 4), 1.0)])
def test_auc_of_one_target(spark, above, want):
    items = spark.createDataFrame([(i, 1.0 if i in above else 0.0, int(i == 5)) for i in range(1, 1001)], "item long, score double, target int")
    assert abs(ranking.auc(items).first()[0] - want) < 1e-3


def test_top_strict_drops_the_tie_at_the_cut(spark):
    items = spark.createDataFrame([(i, s) for i, s in enumerate([5.0, 4.0, 4.0, 3.0])], "item long, score double")
    assert {r["item"] for r in ranking.top_strict(items, 2).collect()} == {0}
    assert {r["item"] for r in ranking.top_strict(items, 3).collect()} == {0, 1, 2}
    assert {r["item"] for r in ranking.top_with_ties(items, 2).collect()} == {0, 1, 2}


def test_rankings_over_ranges_of_scores(spark):
    """Real-valued scores with ties and without a value, against plain sums; no task gets all scores."""
    rng = np.random.default_rng(12)
    rows = [(i, float(s) if s < 0.97 else None, int(t)) for i, (s, t) in enumerate(zip(np.round(rng.random(700), 2), rng.random(700) < 0.3, strict=True))]
    items = spark.createDataFrame(rows, "item long, score double, target int")
    order = lambda s: -1.0 if s is None else s
    for r in ranking.score_blocks(items, []).collect():
        up = [t for _, s, t in rows if order(s) > order(r["score"])]
        own = [t for _, s, t in rows if order(s) == order(r["score"])]
        assert (r["n"], r["t"], r["above"], r["t_above"], r["all_n"], r["all_t"]) == (len(own), sum(own), len(up), sum(up), 700, sum(t for *_, t in rows))
    for n in (1, 40, 699, 700, 900):
        ranked = sorted((order(s) for _, s, _ in rows), reverse=True)
        assert {r["item"] for r in ranking.top_with_ties(items, n).collect()} == {i for i, s, _ in rows if sum(x > order(s) for x in ranked) < n}
        assert {r["item"] for r in ranking.top_strict(items, n).collect()} == {i for i, s, _ in rows if sum(x >= order(s) for x in ranked) <= n}


def test_numbers_and_folds(spark):
    rows = [(i, (i * 37) % 11 if i % 9 else None) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, value long")
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
    assert {r["id"]: r["rank"] for r in value_ranks(df).collect()} == want
    assert value_ranks(df.limit(0)).count() == 0
    for k in (1, 4, 300):
        got = [r["fold"] for r in ranking.folds(df, k, "value", "id").orderBy("value", "id").collect()]
        assert got == sorted(got) == [j + 1 for j in range(k) for _ in range(203 // k + (j < 203 % k))]


def test_factored_cliques_are_their_links(spark):
    rng = np.random.default_rng(3)
    groups = spark.createDataFrame([(i, int(g)) for i, g in enumerate(rng.integers(0, 4, 14))] + [(15, 9)], "id long, group int")
    g = {r["id"]: r["group"] for r in groups.collect()}
    b = np.array([[float(i != j and i in g and j in g and g[i] == g[j]) for j in range(16)] for i in range(16)])
    m = CliqueMatrix.of_groups(groups, 16)
    dense = lambda x, shape: _dense(x, shape)
    assert np.array_equal(dense(m, (16, 16)), b)
    a = rng.integers(0, 3, (16, 5)).astype(float)
    assert np.array_equal(dense(m.multiply(sparse(spark, a)), (16, 5)), b @ a)
    assert {r["id"]: r["n"] for r in m.row_counts().collect()} == {i: int(n) for i, n in enumerate(b.sum(axis=1)) if n}
    plain = CoordMatrix(m.cells, 16, 16)
    assert sorted(map(tuple, graph.components(m).collect())) == sorted(map(tuple, graph.components(plain).collect()))
    ids = spark.range(3, 12)
    assert np.array_equal(dense(m.slice(ids, ids), (16, 16)), b * np.outer(*[(np.arange(16) >= 3) & (np.arange(16) < 12)] * 2))


def _dense(m, shape):
    out = np.zeros(shape)
    for r in m.cells.collect():
        out[r["row"], r["col"]] += r["value"]
    return out


def test_held_products_and_scaling(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, (9, 6)).astype(float), rng.integers(0, 3, (6, 7)).astype(float)
    for most in (0, 1 << 20):
        assert np.array_equal(_dense(sparse(spark, a).multiply_held(sparse(spark, b), most), (9, 7)), a @ b)
    s = a @ a.T + 1
    scaled, rounds = sparse(spark, s).balanced_by_scaling(50, 1e-3)
    got = _dense(scaled, (9, 9))
    assert rounds < 50 and np.abs(got - got.T).max() < 1e-3 and np.allclose((got**2).sum(axis=0), 1)
    assert not sparse(spark, a).has_negative().first()[0] and sparse(spark, -a).has_negative().first()[0]


def test_components_and_trees(spark):
    m = CoordMatrix.from_rows(spark, [(0, 1, 1), (1, 0, 1), (3, 4, 2), (4, 3, 2)], (6, 6))
    assert {r["id"]: r["component"] for r in graph.components(m).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}
    w = {(0, 1): 4, (0, 2): 1, (1, 2): 2, (2, 3): 7, (1, 3): 3}
    g = CoordMatrix.from_rows(spark, [(*k, v) for k, v in w.items()], (4, 4))
    assert sorted(r["value"] for r in graph.spanning_tree(g).collect()) == [1, 2, 3]
    assert sorted(r["value"] for r in graph.spanning_tree(g, largest=True).collect()) == [3, 4, 7]
    assert graph.is_tree(graph.generate(spark, "chain", 6))
    assert graph.is_tree(graph.generate(spark, "tree1", 6))
    assert not graph.is_tree(graph.generate(spark, "complete", 4))
    assert graph.is_connected(graph.connected_supergraph(m)).first()[0]


def test_svd_matches_numpy(spark, a):
    u, s, v = factor.svd(sparse(spark, a), 2, rounds=20)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-4)


def test_signed_eigenvalues(spark):
    b = np.array([[0, 2, 0], [2, 0, 1], [0, 1, 0.0]])
    w, _ = factor.symmetric_eigen(sparse(spark, b), 2, rounds=3)
    assert np.allclose(sorted(w), [-np.sqrt(5), np.sqrt(5)], atol=1e-6)


@pytest.mark.parametrize("kind", ["ls", "kl"])
def test_nmf_objective_falls(spark, a, kind):
    b, c, history = factor.nmf(sparse(spark, a), 2, rounds=4, divergence=kind)
    assert all(y <= x + 1e-6 for x, y in zip(history, history[1:], strict=False))
    if kind == "ls":
        fit = np.array([r["vec"] for r in b.orderBy("id").collect()]) @ np.array([r["vec"] for r in c.orderBy("id").collect()]).T
        assert np.isclose(((a - fit) ** 2).sum(), history[-1])


def test_bregman_and_residue_objectives_fall(spark):
    a = np.random.default_rng(3).integers(1, 9, (8, 6)).astype(float)
    m = sparse(spark, a)
    res = bregman.cocluster(m, 2, 2, basis=2, divergence="e", rounds=3)
    assert all(y <= x + 1e-9 for x, y in zip(res.objectives, res.objectives[1:], strict=False))
    for kind in (1, 2):
        res = cocluster.mssr(m, 2, 2, kind=kind, rounds=3)
        assert res.objectives[-1] <= res.objectives[0] + 1e-9
        g = {r["id"]: r["cluster"] for r in res.rows.collect()}
        h = {r["id"]: r["cluster"] for r in res.cols.collect()}
        want = 0.0
        for x in set(g.values()):
            for y in set(h.values()):
                b = a[np.ix_([i for i in g if g[i] == x], [j for j in h if h[j] == y])]
                want += ((b - b.mean()) ** 2).sum() if kind == 1 else ((b - b.mean(1, keepdims=True) - b.mean(0) + b.mean()) ** 2).sum()
        assert np.isclose(want, res.objectives[-1])


@pytest.mark.parametrize("kind", [1, 2, "itcc"])
def test_local_search_gains_what_it_says(spark, kind):
    a = np.random.default_rng(5).integers(0, 9, (6, 5)).astype(float)
    m = cocluster.joint(sparse(spark, a)) if kind == "itcc" else sparse(spark, a)
    rows, cols = bregman.initial_labels(spark.range(6), 2), bregman.initial_labels(spark.range(5), 2)
    value = lambda r: (cocluster.information_loss(m, r, cols) if kind == "itcc" else cocluster.residue(m, r, cols, kind)).first()[0]
    before = value(rows)
    every = {}
    for i in range(6):  # all single moves, one by one
        old = rows.filter(F.col("id") == i).first()["cluster"]
        every[i] = value(rows.withColumn("cluster", F.when(F.col("id") == i, 1 - old).otherwise(F.col("cluster")))) - before
    move = cocluster_moves.best_row_move(m, rows, cols, kind=kind).first()
    assert np.isclose(move["change"], min(every.values())) and np.isclose(every[move["id"]], move["change"])
    new, gain = cocluster_moves.local_search(m, rows, cols, 2, kind=kind)
    assert gain <= 0 and np.isclose(value(new) - before, gain)


def test_farthest_start_against_plain(spark):
    a = np.random.default_rng(9).integers(0, 6, (9, 6)).astype(float)
    a[4] = 0
    p, k, alpha = a / a.sum(), 3, 0.1
    got = {r["id"]: r["cluster"] for r in cocluster.farthest_start(sparse(spark, p), k, alpha).collect()}
    rows = [i for i in range(9) if p[i].sum()]
    share = {i: p[i] / p[i].sum() for i in rows}
    smooth = lambda q: (q + alpha / 6) / (1 + alpha)
    d = lambda i, q: sum(x * np.log(x / y) for x, y in zip(share[i], smooth(q), strict=True) if x)
    chosen = [max(rows, key=lambda i: (round(d(i, p.sum(axis=0)), 9), -i))]
    while len(chosen) < k:
        chosen.append(max((i for i in rows if i not in chosen), key=lambda i: (round(sum(d(i, share[c]) for c in chosen), 9), -i)))
    assert got == {i: min(range(k), key=lambda c: (round(d(i, share[chosen[c]]), 9), c)) if i in rows else 0 for i in range(9)}


def test_rowwise_products_are_the_joined_ones(spark):
    import numpy as np

    from gridloom.operators import rowwise

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, (23, 9)) * (rng.random((23, 9)) < 0.3), rng.integers(0, 4, (9, 31)) * (rng.random((9, 31)) < 0.4)
    of = lambda x: CoordMatrix.from_rows(spark, [(i, j, x[i, j]) for i, j in zip(*np.nonzero(x), strict=True)], x.shape)
    cells = lambda m: sorted(map(tuple, m.cells.select("row", "col", "value").collect()))
    for left, right in ((a, b), (a, -b), (a - 1, b)):
        m, n = of(left), of(right)
        assert cells(rowwise.multiply(m, n, span=5, laid=40)) == cells(m.multiply(n)) == cells(rowwise.multiply(m, n))
    square = rng.integers(0, 3, (9, 9))
    m, n = of(a), of(square)
    want = cells(m.multiply(n).without(m))
    assert cells(rowwise.multiply(m, n, unknown=True, span=4, laid=30)) == want
    top = sorted(want, key=lambda x: (-x[2], x[1], x[0]))[:7]
    got = cells(rowwise.multiply(m, n, strongest=7, unknown=True, span=4, laid=30))
    assert sorted(got, key=lambda x: (-x[2], x[1], x[0]))[:7] == top and len(got) < len(want)


def test_links_of_cliques_leave_no_distinct_and_come_from_packs(spark):
    from gridloom.operators import graph

    groups = spark.createDataFrame([(i, i % 3 if i < 2600 else i) for i in range(2603)], "id bigint, group bigint")
    m = CliqueMatrix.of_groups(groups, 2604)
    sizes = [len(range(r, 2600, 3)) for r in range(3)]
    assert m.cells.count() == m.cells.distinct().count() == sum(s * (s - 1) for s in sizes)
    assert m.cells.filter("row % 3 <> col % 3 OR row = col OR row >= 2600 OR col >= 2600").isEmpty()
    got = graph.connected_supergraph(m).cells.filter("row < col").select("row", "col")
    links = {tuple(r) for r in got.filter("row % 3 <> col % 3 OR col >= 2600").collect()}
    assert links == {(0, 1), (1, 2), (2, 2600), (2600, 2601), (2601, 2602), (2602, 2603)}
    assert got.count() == sum(s * (s - 1) // 2 for s in sizes) + 6
    assert "Generate explode" in m.cells._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("span", [4096, 3])
def test_joint_katz_of_cliques_is_one_product(spark, monkeypatch, span):
    """Cliques of many, two and one members, users of no clique and without groups: the cells of the three products, and B*A is not made."""
    r = np.random.default_rng(5)
    a = (r.random((30, 12)) < 0.2).astype(float)
    a[7], a[28] = 0, 1
    group = {i: "a" if i < 15 else "b" if i < 25 else "c" if i < 27 else "d" for i in range(28)}
    b = np.array([[float(i != j and i in group and group.get(i) == group.get(j)) for j in range(30)] for i in range(30)])
    ba, l, beta = b @ a, 0.2, 0.01
    want = l * ba + beta * (l * l * b @ ba + a @ a.T @ a)
    cliques = CliqueMatrix.of_groups(spark.createDataFrame([(i, g) for i, g in group.items()], "id long, group string"), 30)
    monkeypatch.setattr(CliqueMatrix, "multiply", lambda *_: pytest.fail("B*A is made"))
    multiply = rowwise.multiply
    monkeypatch.setattr(rowwise, "multiply", lambda *x, **y: multiply(*x, **y, span=span, laid=50))
    cells = katz.joint3(cliques, CoordMatrix(spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, value double"), 30, 12), l, -2).cells.collect()
    got = np.zeros((30, 12))
    for x in cells:
        got[x["row"], x["col"]] = x["value"]
    assert np.allclose(got, want, atol=1e-12) and len(cells) == (want > 1e-12).sum()


def test_clique_links_leave_a_pack_at_a_time(spark):
    """The two explodes of a pair of packs lie in different generated loops, so no task holds the pair's million links."""
    groups = spark.createDataFrame([(i, i % 2) for i in range(9)], "id long, group int")
    m = CliqueMatrix.of_groups(groups, 9)
    plan = m.cells._jdf.queryExecution().executedPlan().toString()
    first, second = [at for at in range(len(plan)) if plan.startswith("Generate explode", at)]
    assert "Coalesce" in plan[first:second]
    want = sorted((i, j) for i in range(9) for j in range(9) if i != j and i % 2 == j % 2)
    assert sorted((r["row"], r["col"]) for r in m.cells.collect()) == want


def test_katz_of_memberships_has_all_its_terms(spark):
    """The query's own settings, on memberships so few that a third step reaches groups which one or two do not; against a plain version."""
    a = np.zeros((6, 6))
    for i in range(5):
        a[i, i] = a[i, i + 1] = 1
    a[5, 0] = 1
    want = sum(1e-3**i * np.linalg.matrix_power(a @ a.T, i) for i in (1, 2, 3)) @ a
    got = katz.membership(sparse(spark, a), 1e-3)
    assert np.allclose(dense(got), want, rtol=1e-12, atol=0) and got.cells.count() == (want > 0).sum() > ((a @ a.T @ a) > 0).sum()


def test_katz_membership_query_takes_three_terms(spark):
    from helpers import SF

    from gridloom.plans import inputs, registry

    a = dense(inputs.user_group(spark, SF))
    want = sum(1e-3**i * np.linalg.matrix_power(a @ a.T, i) for i in (1, 2, 3)) @ a
    rows = registry.QUERIES["katz_membership"](spark, SF).collect()
    assert len(rows) == (want > 0).sum()
    assert all(abs(r["value"] - want[r["row"], r["col"]]) < 1e-9 for r in rows)


def test_rows_of_many_cells_are_multiplied_laid_out(spark):
    """Both ways of a block give the cells of the join, with cells that cancel out and column parts cut anywhere."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(-2, 3, (9, 40)), rng.integers(-2, 3, (40, 17)) * (rng.random((40, 17)) < 0.3)
    packs = [(k, np.flatnonzero(x), x[x != 0].astype(float)) for k, x in enumerate(b) if x.any()]
    rows = [(k, np.flatnonzero(x), x[x != 0].astype(float)) for k, x in enumerate(a)]
    every, spots = rowwise._numbered([p[1] for p in packs])
    at = {p[0]: n for n, p in enumerate(packs)}
    places = [(np.array([at[i] for i in ids if i in at]), np.array([v for i, v in zip(ids, values, strict=True) if i in at])) for _, ids, values in rows]
    for way in (rowwise._added, rowwise._laid_out):
        got, there = np.zeros((9, 17)), np.zeros((9, 17), bool)
        for n, part, v, has in way(packs, spots, every, places, False, 200):
            got[n, part[has]], there[n, part[has]] = v[has], True
        assert np.allclose(got, a @ b) and (there == ((a != 0).astype(int) @ (b != 0) > 0)).all()


def test_rows_of_few_cells_lay_no_packs_out(spark, monkeypatch):
    """As those of a large clique, which meet its sums and a few groups out of very many: also where a pack is wide and held as one row."""
    monkeypatch.setattr(rowwise, "_laid_out", lambda *_: pytest.fail("packs are laid out"))
    rng = np.random.default_rng(9)
    b = rng.integers(1, 4, (300, 200)) * (rng.random((300, 200)) < 0.05)
    b[7] = rng.integers(-3, 4, 200)
    packs = [(k, np.flatnonzero(x), x[x != 0].astype(float)) for k, x in enumerate(b) if x.any()]
    rows = [(k, np.array([7, 20 + k, 90 + k]), np.array([0.5, 1.0, 2.0])) for k in range(60)]
    got = np.zeros((60, 200))
    for batch in rowwise._products(packs, rows, None, None, False, rowwise.LAID):
        r, c, v = (batch.column(n).to_numpy() for n in range(3))
        got[r, c] = v
    assert np.allclose(got, [0.5 * b[7] + b[20 + k] + 2 * b[90 + k] for k in range(60)])


def test_rounding_in_floating_point_is_that_of_round(spark):
    from gridloom.plans.matrix_queries import _half_up

    values = [0.0, 0.7444, 1e-7, 123456.7890125, 5e9 + 0.25, 1e300, -0.7444, 81.2344999]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    for r in df.select(F.round("value", 6).alias("a"), _half_up("value", 6).alias("b")).collect():
        assert r["a"] == r["b"]
