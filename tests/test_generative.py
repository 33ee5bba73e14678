"""Trees by class, learning curves, recovery trials and active-set factorisation against plain versions."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.matrix import CoordMatrix
from gridloom.operators import active_nmf, factor, fields, generative


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        y = int(rng.random() < 0.4)
        a = int(rng.integers(0, 3))
        b = a if rng.random() < (0.8 if y else 0.2) else int(rng.integers(0, 3))
        rows.append((str(k), y, [a, b, int(rng.integers(0, 2 + y))]))
    return rows, spark.createDataFrame(rows, "key string, y int, x array<int>")


def plain_log(rows, y, parents, x):
    own = [r[2] for r in rows if r[1] == y]
    out = np.log(len(own) / len(rows))
    for i, p in enumerate(parents):
        same = own if p < 0 else [v for v in own if v[p] == x[p]]
        out += np.log((sum(v[i] == x[i] for v in same) + 1) / (len(same) + 3))
    return out


def test_trees_against_plain_counts(spark, lines):
    rows, df = lines
    model = generative.fit_trees(df, 3, 3, parents=[-1, 0, 1])
    for r in df.select("x", model.log_odds().alias("o"), model.predicted().alias("p")).distinct().collect():
        want = [plain_log(rows, y, [-1, 0, 1], r["x"]) for y in (0, 1)]
        assert np.isclose(r["o"], want[1] - want[0]) and r["p"] == int(want[1] > want[0])
    for tree in model.trees:  # normalised exactly
        total = sum(np.exp(sum(t[x[i]] if p < 0 else t[x[p], x[i]] for i, (p, t) in enumerate(zip(tree.parents, tree.tables, strict=True)))) for x in product(range(3), repeat=3))
        assert np.isclose(total, 1)


def test_best_tree_is_the_largest(spark, lines):
    rng = np.random.default_rng(1)
    w = rng.random((5, 5))
    w = w + w.T
    got = generative.best_tree(w)
    own = sum(w[i, p] for i, p in enumerate(got) if p >= 0)

    def connected(edges):
        group = list(range(5))
        for a, b in edges:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
        return len(set(group)) == 1

    assert np.isclose(own, max(sum(w[e] for e in t) for t in combinations(list(combinations(range(5), 2)), 4) if connected(t)))
    _, df = lines
    assert generative.fit_trees(df, 3, 3).trees[1].parents[1] == 0  # a and b hang together


def test_curves_equal_a_loop(spark, lines):
    rows, df = lines
    got = {r["size"]: r for r in generative.learning_curves(df, df, 3, 3, [150, 600], trials=2).collect()}
    drawn = generative._in_trials(df, 2, [150, 600], "key")
    for size in (150, 600):
        errors, weights = [], []
        for trial in range(2):
            sample = drawn.filter((F.col("trial") == trial) & (F.col("size") == size)).select("key", "x", "y")
            model = generative.fit_trees(sample, 3, 3)
            n = [r[0] for r in sample.groupBy("y").count().orderBy("y").select("count").collect()]
            model.shares = [float(np.log((v + 1) / (sum(n) + 2))) for v in n]
            errors.append(generative.misclassified(df, model.predicted()))
            counts = {tuple(r["x"]): [r["a"], r["b"]] for r in sample.groupBy("x").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b")).collect()}
            w = generative._newton(np.array(list(counts.values()), float), np.array(list(counts)), 3)
            weights.append(np.mean([(fields._indicators(np.array([r[2]]), 3) @ w > 0)[0] != r[1] for r in rows]))
        assert np.isclose(got[size]["generative"], np.mean(errors)) and np.isclose(got[size]["discriminative"], np.mean(weights))
    small, large = (drawn.filter((F.col("trial") == 0) & (F.col("size") == s)).select("key") for s in (150, 600))
    assert small.exceptAll(large).count() == 0


def test_trials_equal_a_loop_and_go_on_where_they_stopped(spark, lines, tmp_path):
    _, df = lines
    ask = {"nodes": 3, "states": 3, "sizes": [200, 500], "penalties": [0.2, 0.02], "rounds": 150}
    whole = {tuple(r) for r in generative.trial_edges(df, trials=3, **ask).collect()}
    drawn, want = generative._in_trials(df.select("key", "x"), 3, [200, 500], "key"), set()
    for t, size in product(range(3), (200, 500)):
        for step in fields.neighbourhood_path(drawn.filter((F.col("trial") == t) & (F.col("size") == size)), 3, 3, [0.2, 0.02], rounds=150):
            n = fields.block_norms(step, 3, 3)
            found = [(a, b) for a in range(3) for b in range(a + 1, 3) if max(n[a, b], n[b, a]) > 0.05]
            want |= {(t, size, step.penalty, a, b) for a, b in found or [(-1, -1)]}
    assert whole == want
    store = str(tmp_path / "trials")
    assert {tuple(r) for r in generative.trial_edges(df, trials=1, store=store, **ask).collect()} == {r for r in whole if r[0] == 0}
    assert {tuple(r) for r in generative.trial_edges(df, trials=3, store=store, **ask).collect()} == whole
    files = sorted(p.name for p in (tmp_path / "trials").glob("part-*"))
    generative.trial_edges(df, trials=3, store=store, **ask).collect()
    assert files == sorted(p.name for p in (tmp_path / "trials").glob("part-*"))  # nothing is run again
    curve = {(r["size"], r["penalty"]): (r["success"], r["differing"]) for r in generative.success_curve(spark.createDataFrame(sorted(whole), "trial int, size int, penalty double, a int, b int"), {(0, 1)}).collect()}
    for (size, penalty), (success, differing) in curve.items():
        each = [{r[3:] for r in whole if r[:3] == (t, size, penalty)} - {(-1, -1)} for t in range(3)]
        assert np.isclose(success, np.mean([e == {(0, 1)} for e in each])) and np.isclose(differing, np.mean([len(e ^ {(0, 1)}) for e in each]))


# Active sets


def least_squares(t, g):
    """The least row over all sets of free components."""
    k, best = len(t), (0.0, np.zeros(len(t)))
    for size in range(1, k + 1):
        for on in map(list, combinations(range(k), size)):
            x = np.zeros(k)
            x[on] = np.linalg.lstsq(g[np.ix_(on, on)], t[on], rcond=None)[0]
            if (x >= 0).all():
                best = min(best, (0.5 * x @ g @ x - t @ x, x), key=lambda v: v[0])
    return best


def test_rows_become_optimal():
    rng = np.random.default_rng(5)
    c = rng.random((9, 4))
    g, t = c.T @ c, rng.normal(size=(40, 4)) * 3
    got = active_nmf.newton_rows(rng.random((40, 4)), t, g, 100)
    for x, row in zip(got, t, strict=True):
        assert np.isclose(0.5 * x @ g @ x - row @ x, least_squares(row, g)[0], atol=1e-8) and (x >= 0).all()
    flat = np.zeros((4, 4))
    assert np.isfinite(active_nmf.newton_rows(np.ones((3, 4)), np.zeros((3, 4)), flat, 5)).all()


def test_objective_falls_below_that_of_als(spark):
    rng = np.random.default_rng(0)
    a = rng.random((12, 3)) ** 2 @ (rng.random((3, 10)) ** 2) * 9 + rng.random((12, 10)) * 0.3
    m = CoordMatrix.from_rows(spark, [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], a.shape)
    plain = factor.nonnegative_als(m, 3, rounds=4)[2]
    for exact in (False, True):
        b, c, history = active_nmf.active_set_nmf(m, 3, rounds=4, exact=exact)
        assert all(y <= x + 1e-9 for x, y in zip(history, history[1:], strict=False))
        if exact:
            assert history[-1] <= plain[-1] + 1e-9
            assert active_nmf.residuals(m.transpose(), c, b, 3).agg(F.max("residual")).first()[0] < 1e-6
