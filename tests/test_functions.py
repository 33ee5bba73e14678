import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import divergence, scalar
from gridloom.operators import dense, information, learn, optimise
from gridloom.sources import formats


def test_interval_lookup(spark):
    points = spark.createDataFrame([(x,) for x in (2.5, 1.5, 5.0, 6.0, -1.0)], "x double")
    domain = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0), (5.0, 5.0)], "lo double, hi double")
    got = {r["x"]: (r["floor"], r["ceiling"]) for r in scalar.interval_lookup(points, domain).collect()}
    assert got == {2.5: (2, 3), 1.5: (1.5, 1.5), 5.0: (5, 5), 6.0: (5, math.inf), -1.0: (-math.inf, 1)}


def test_normal(spark):
    df = spark.createDataFrame([(0.0,), (math.inf,), (-math.inf,), (1.96,)], "x double")
    got = [r[0] for r in df.select(scalar.normal_cdf("x", F.lit(0.0), F.lit(1.0))).collect()]
    assert np.allclose(got, [0.5, 1, 0, 0.9750021])
    assert np.isclose(scalar.normal_quantile(0.975), 1.959964)


def test_array_functions(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.5, 0.5])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    r = df.select(divergence.kl(x, y).alias("kl"), divergence.symmetric_kl(x, y).alias("s"), divergence.pair_products(F.array(F.lit(2.0), F.lit(3.0), F.lit(5.0))).alias("p"), divergence.norm_l2(x).alias("n")).first()
    kl = lambda a, b: sum(i * math.log(i / j) for i, j in zip(a, b, strict=True))
    assert np.isclose(r["kl"], kl((0.2, 0.8), (0.5, 0.5)))
    assert np.isclose(r["s"], (kl((0.2, 0.8), (0.5, 0.5)) + kl((0.5, 0.5), (0.2, 0.8))) / 2)
    assert r["p"] == [6, 10, 15]


@pytest.mark.parametrize("method", ["active", "lbfgs", "bb"])
def test_nnls(method):
    rng = np.random.default_rng(0)
    a, want = rng.random((20, 4)), np.array([1.0, 0, 2, 0])
    assert np.allclose(optimise.nnls(a, a @ want, method), want, atol=1e-3)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 6), st.integers(0, 10_000))
def test_decompositions(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n))
    q, r = dense.gram_schmidt(a)
    assert np.allclose(q @ r, a)
    w, r = dense.householder(a)
    assert np.allclose(dense.reflections_to_q(w) @ r, a)
    lower, u, rows = dense.lu(a)
    assert np.allclose(a[rows], lower @ u)
    lower, u, rows, cols = dense.lu(a, complete=True)
    assert np.allclose(a[rows][:, cols], lower @ u)


def test_optimisers():
    assert np.isclose(optimise.bisect(lambda x: x * x, 2, 0, 4), math.sqrt(2), atol=1e-3)
    x, _, _ = optimise.lbfgs(optimise.rosenbrock, np.zeros(100), o=optimise.Options(rounds=3000, progress=1e-15))
    assert np.allclose(x, 1, atol=1e-3)
    assert optimise.minimise_grid([range(4), range(3)], lambda a, b: (a - 2) ** 2 + (b - 1) ** 2) == (0, (2, 1))
    assert optimise.minimise_until_rise([3, 2, 1, 5, 0], float) == (1, 1)
    assert np.allclose(optimise.barrier(lambda x: float(x @ x), [lambda x: 1 - x[0]], [3.0, 2.0]), [1, 0], atol=0.05)
    assert np.isclose(scalar.ellipse_area([[2, 0], [0, 1]]), 2 * math.pi)


def test_learning(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    beta = learn.logistic_l1(df, ["a", "b"], "y", 0.05, rounds=40)
    assert beta[1] > 0.5 and beta[2] == 0
    f, g = learn.logistic_loss(df, ["a", "b"], "y", np.array([0.1, 0.2, 0.3]))
    e = 1e-5
    up, down = (learn.logistic_loss(df, ["a", "b"], "y", np.array([0.1, 0.2 + s, 0.3]))[0] for s in (e, -e))
    assert np.isclose((up - down) / (2 * e), g[1], atol=1e-6)


def test_gibbs_agrees_with_exact_marginals(spark):
    j = np.zeros((3, 3))
    j[0, 1] = j[1, 0] = 0.5
    j[1, 2] = j[2, 1] = -0.3
    h = np.array([0.4, 0.0, 0.2])
    s = learn.gibbs(spark, j, h, 4000, chains=4, burn_in=50, gap=2)
    got = {r["node"]: r["p"] for r in s.groupBy("node").agg(F.avg("state").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(3)], learn.tree_marginals(j, h), atol=0.04)


def test_compressed_files(spark, tmp_path):
    from gridloom.matrix import CoordMatrix

    m = CoordMatrix.from_rows(spark, [(0, 0, 2), (2, 0, 3), (1, 2, 7)], (3, 4))
    for kind in ("float64", "uint8"):
        (tmp_path / "m.bin").write_bytes(formats.encode_ccs(m, kind))
        back = formats.read_ccs(spark, str(tmp_path / "m.bin"), kind)
        assert (back.n_rows, back.n_cols) == (3, 4)
        assert sorted(map(tuple, back.cells.collect())) == sorted(map(tuple, m.cells.collect()))
    for end, text in (("dim", "3 4 3"), ("col_ccs", "0 2 2 3 3"), ("row_ccs", "0 2 1"), ("txx_nz", "2 3 7")):
        (tmp_path / f"m_{end}").write_text(text)
    back, empty = formats.read_ccs_text(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.cells.collect())) == sorted(map(tuple, m.cells.collect()))
    assert empty == [1, 3]


def test_text_files(spark, tmp_path):
    (tmp_path / "d").write_text("2 3\n1 0 2\n0 5 0\n")
    assert sorted(map(tuple, formats.read_dense(spark, str(tmp_path / "d")).collect())) == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 5.0)]
    (tmp_path / "l").write_text("3\n1\n2\n1\n")
    assert [(r["id"], r["cluster"]) for r in formats.read_labels(spark, str(tmp_path / "l"), offset=1).orderBy("id").collect()] == [(0, 0), (1, 1), (2, 0)]
    (tmp_path / "bad").write_text("3\n1\n")
    with pytest.raises(ValueError):
        formats.read_labels(spark, str(tmp_path / "bad"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "id long, cluster int")
    formats.write_labels(labels, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_messages_on_a_cycle_and_other_models(spark):
    """Belief propagation: exact on trees, near the exact marginals on a weak cycle; negated models mirror them."""
    from itertools import product

    def exact(j, h):
        p = {x: np.exp(sum(j[a, b] * x[a] * x[b] for a in range(len(h)) for b in range(a)) + np.dot(h, x)) for x in product((-1, 1), repeat=len(h))}
        return np.array([sum(v for x, v in p.items() if x[i] == 1) for i in range(len(h))]) / sum(p.values())

    ring = np.zeros((4, 4))
    for a in range(4):
        ring[a, (a + 1) % 4] = ring[(a + 1) % 4, a] = 0.15
    h = np.array([0.3, -0.1, 0.0, 0.2])
    got, rounds = learn.belief_propagation(ring, h)
    assert rounds < 200 and np.allclose(got, exact(ring, h), atol=5e-3)
    chain = learn.pairwise_couplings(np.eye(4, k=1) + np.eye(4, k=-1), 0.2, 0.5, "uniform", seed=3)
    assert np.allclose(chain, chain.T) and np.all(chain[chain > 0] >= 0.2) and np.allclose(learn.tree_marginals(chain, h), exact(chain, h))
    assert np.allclose(learn.tree_marginals(*learn.negated(chain * 0, h)), 1 - learn.tree_marginals(chain * 0, h))


def test_pseudo_likelihood_and_choice_of_penalty(spark):
    j = 0.5 * (np.eye(3, k=1) + np.eye(3, k=-1))
    long = learn.gibbs(spark, j, np.zeros(3), 600, chains=3, burn_in=40, gap=3)
    s = learn.observed(long)
    rows = {}
    for r in long.collect():
        rows.setdefault(r["sample"], {})[r["node"]] = 2 * r["state"] - 1
    want = np.mean([sum(np.log1p(np.exp(-2 * x[i] * sum(j[i, k] * x[k] for k in range(3) if k != i))) for i in range(3)) for x in rows.values()])
    assert np.isclose(learn.pseudo_likelihood(s, j, np.zeros(3)).first()["loss"], want)
    found, c = learn.ising_validated(s, 3, [0.1, 40.0], folds=2, rounds=12)
    assert c == 0.1 and np.allclose(found, j, atol=0.2)


def test_repeated_observations_count_each(spark):
    """Doubled rows change no information and no share, and double the counts."""
    rng = np.random.default_rng(6)
    rows = [([int(v) for v in rng.integers(0, 3, 3)],) for _ in range(40)]
    once, twice = (spark.createDataFrame(rows * k, "x array<int>") for k in (1, 2))
    counts = [{tuple(r)[:4]: r["n"] for r in information.pair_counts(df).collect()} for df in (once, twice)]
    assert {k: 2 * n for k, n in counts[0].items()} == counts[1] and sum(counts[0].values()) == 3 * 40
    for f in (information.mutual_information, information.co_occurrence):
        a, b = ({tuple(r)[:2]: r[2] for r in f(df).collect()} for df in (once, twice))
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
    binary = lambda df: df.selectExpr("transform(x, v -> if(v > 0, 1, 0)) AS x")
    j = 0.3 * (np.eye(3, k=1) + np.eye(3, k=-1))
    assert learn.wide(twice, 3).count() == 80
    assert np.isclose(*(learn.pseudo_likelihood(binary(df), j, np.zeros(3)).first()["loss"] for df in (once, twice)))


def test_compressed_text_round_trip_in_several_tasks(spark, tmp_path, monkeypatch):
    from gridloom.matrix import CoordMatrix

    monkeypatch.setattr(formats, "BLOCK", 16)
    rng = np.random.default_rng(4)
    a = rng.integers(-4, 9, (60, 50)) * (rng.random((60, 50)) < 0.2) / 4
    a[:, 7] = np.arange(1, 61)  # a column over several blocks
    a[:, [0, 20, 49]] = 0
    m = CoordMatrix.from_rows(spark, [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], a.shape)
    name = str(tmp_path / "m")
    formats.write_ccs_text(m, name)
    assert len(list((tmp_path / "m_row_ccs").glob("part-*"))) > 1
    whole = lambda end: [w for p in sorted((tmp_path / f"m_{end}").glob("part-*")) for w in p.read_text().split()]
    order = sorted((j, i) for i, j in zip(*np.nonzero(a), strict=True))
    assert whole("row_ccs") == [str(i) for _, i in order] and [float(v) for v in whole("txx_nz")] == [a[i, j] for j, i in order]
    assert [int(p) for p in whole("col_ccs")] == np.concatenate([[0], np.cumsum((a != 0).sum(axis=0))]).tolist()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        for end in ("row_ccs", "col_ccs", "txx_nz", "dim"):  # as one file each, cut by Spark in ranges of a few bytes
            (tmp_path / f"one_{end}").write_text("\n".join(whole(end)) + "\n")
        for source in (name, str(tmp_path / "one")):
            back, empty = formats.read_ccs_text(spark, source)
            assert (back.n_rows, back.n_cols) == (60, 50) and empty == [int(j) for j in np.flatnonzero(~(a != 0).any(axis=0))]
            assert sorted(map(tuple, back.cells.collect())) == sorted((int(i), int(j), float(a[i, j])) for j, i in order)
        (tmp_path / "dense").write_text("60 50\n" + "\n".join(" ".join(str(v) for v in row) for row in a) + "\n")
        got = sorted(map(tuple, formats.read_dense(spark, str(tmp_path / "dense")).collect()))
        assert got == sorted((int(i), int(j), float(a[i, j])) for j, i in order)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_matrix_in_text(spark, tmp_path):
    from gridloom.matrix import CoordMatrix

    formats.write_ccs_text(CoordMatrix(spark.createDataFrame([], "row bigint, col bigint, value double"), 2, 3), str(tmp_path / "e"))
    back, empty = formats.read_ccs_text(spark, str(tmp_path / "e"))
    assert (back.n_rows, back.n_cols, back.cells.count(), empty) == (2, 3, 0, [0, 1, 2])
