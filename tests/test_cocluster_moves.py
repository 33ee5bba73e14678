"""Chains of single moves and reversed rows against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.matrix import CoordMatrix
from gridloom.operators import bregman, cocluster, cocluster_moves, cocluster_signed


def sparse(spark, a):
    return CoordMatrix.from_rows(spark, [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], a.shape)


def plogp(x):
    x = x[x > 1e-15]
    return float((x * np.log2(x)).sum())


def objective(a, g, h, kind):
    if kind == "itcc":
        blocks = np.array([[a[np.ix_(g == x, h == y)].sum() for y in range(h.max() + 1)] for x in range(g.max() + 1)])
        information = lambda z: plogp(z) - plogp(z.sum(axis=1)) - plogp(z.sum(axis=0))
        return information(a) - information(blocks)
    out = 0.0
    for x in set(g.tolist()):
        for y in set(h.tolist()):
            b = a[np.ix_(g == x, h == y)]
            out += ((b - b.mean()) ** 2).sum() if kind == 1 else ((b - b.mean(1, keepdims=True) - b.mean(0) + b.mean()) ** 2).sum()
    return out


def plain_chain(a, g, h, length, kind):
    g, out, scale = g.copy(), [], 1.0 if kind == "itcc" else (a**2).sum()
    now = objective(a, g, h, kind)
    for _ in range(length):
        offers = []
        for i in range(len(a)):
            if i in [x[0] for x in out] or (g == g[i]).sum() < 2:
                continue
            for c in sorted(set(g.tolist()) - {g[i]}):
                new = g.copy()
                new[i] = c
                offers.append((round((objective(a, new, h, kind) - now) / scale, 10), i, c))
        if not offers:
            break
        _, i, c = min(offers)
        g[i] = c
        after = objective(a, g, h, kind)
        out.append((i, c, after - now))
        now = after
    return out


@pytest.mark.parametrize("kind", [1, 2, "itcc"])
def test_chain_equals_plain_chain(spark, kind):
    a = np.random.default_rng(7).integers(0, 30, (8, 6)).astype(float)
    a[5] = 0  # a row without cells
    a[a < 8] = 0
    a = a / a.sum() if kind == "itcc" else a
    m, rows, cols = sparse(spark, a), bregman.initial_labels(spark.range(8), 3), bregman.initial_labels(spark.range(6), 2)
    for axis, b, (mine, other), k in (("row", a, (rows, cols), 3), ("col", a.T, (cols, rows), 2)):
        g, h = np.arange(len(b)) % k, np.arange(b.shape[1]) % (5 - k)
        want = plain_chain(b, g, h, 5, kind)
        got = cocluster_moves.chain(m if axis == "row" else m.transpose(), mine, other, 5, kind).orderBy("step").collect()
        assert np.allclose([r["change"] for r in got], [w[2] for w in want])
        assert [(r["id"], r["cluster"]) for r in got] == [(i, c) for i, c, _ in want]
        totals = np.cumsum([0, *[w[2] for w in want]])
        keep = int(np.argmin(np.round(totals, 12)))
        labels, gain = cocluster_moves.local_search(m, rows, cols, 5, 1e-9, kind, axis)
        assert np.isclose(gain, totals[keep])
        for i, c, _ in want[:keep]:
            g[i] = c
        assert {r["id"]: r["cluster"] for r in labels.collect()} == dict(enumerate(g.tolist()))


def test_alternating_search_ends_where_no_chain_gains(spark):
    a = np.random.default_rng(3).integers(0, 9, (7, 6)).astype(float)
    m, rows, cols = sparse(spark, a), bregman.initial_labels(spark.range(7), 2), bregman.initial_labels(spark.range(6), 2)
    before = cocluster.residue(m, rows, cols, 2).first()[0]
    new_rows, new_cols, gains = cocluster_moves.alternating_search(m, rows, cols, 3, kind=2)
    assert gains[-2:] == [0.0, 0.0] and np.isclose(cocluster.residue(m, new_rows, new_cols, 2).first()[0], before + sum(gains))


def test_small_values_are_not_taken_for_ties(spark):
    a = np.random.default_rng(7).integers(0, 30, (6, 5)) * 1e-9
    m, rows, cols = sparse(spark, a), bregman.initial_labels(spark.range(6), 2), bregman.initial_labels(spark.range(5), 2)
    got = cocluster_moves.chain(m, rows, cols, 3).orderBy("step").collect()
    assert [(r["id"], r["cluster"]) for r in got] == [w[:2] for w in plain_chain(a, np.arange(6) % 2, np.arange(5) % 2, 3, 1)]


# Reversed rows


def test_opposite_rows_share_a_cluster(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=6), rng.normal(size=6)
    a = np.array([x, -x, y, x, -y, -x, y, -y])
    m = sparse(spark, a)
    rows = spark.createDataFrame([(i, c, 1) for i, c in enumerate([0, 1, 1, 0, 0, 1, 1, 0])], "id bigint, cluster int, sign int")
    cols = spark.range(6).select("id", F.col("id").cast("int").alias("cluster"))
    res = cocluster_signed.mssr_signed(m, 2, 6, rows=rows, cols=cols, threshold=0.0)
    assert all(y <= x + 1e-9 for x, y in zip(res.objectives, res.objectives[1:], strict=False))
    if res.objectives[-1] < 1e-9:
        label = {r["id"]: (r["cluster"], r["sign"]) for r in res.rows.collect()}
        assert label[0][0] == label[1][0] == label[3][0] and label[0][1] == -label[1][1]


@pytest.mark.parametrize("kind", [1, 2])
def test_signed_step_against_plain(spark, kind):
    rng = np.random.default_rng(kind)
    a = rng.normal(size=(9, 7))
    a[rng.random((9, 7)) < 0.3] = 0
    g, s, h = np.arange(9) % 3, np.where(np.arange(9) % 2, -1, 1), np.arange(7) % 2
    m = sparse(spark, a)
    rows = spark.createDataFrame([(i, int(g[i]), int(s[i])) for i in range(9)], "id bigint, cluster int, sign int")
    cols = bregman.initial_labels(spark.range(7), 2)
    b = a * s[:, None]

    def lose(v):  # residue II takes each row's means by column cluster away
        return v if kind == 1 else v - np.array([v[h == h[j]].mean() for j in range(7)])

    centre = {c: np.array([b[np.ix_(g == c, h == h[j])].mean() for j in range(7)]) if kind == 1 else lose(b[g == c].mean(axis=0)) for c in range(3)}
    got = {r["id"]: (r["cluster"], r["sign"]) for r in cocluster_signed.reassigned(m, rows, cols, kind).collect()}
    for i in range(9):
        offers = {(c, t): ((lose(t * b[i]) - centre[c]) ** 2).sum() for c in range(3) for t in (1, -1)}
        c, t = min(offers, key=lambda x: (round(offers[x], 9), x != (g[i], 1), x[0], x[1] != 1))
        assert got[i] == (c, t * s[i])
    assert np.isclose(cocluster_signed.residue(m, rows, cols, kind).first()[0], objective(b, g, h, kind))


def test_columns_may_be_reversed_too(spark):
    a = np.random.default_rng(5).normal(size=(6, 6))
    res = cocluster_signed.mssr_signed(sparse(spark, a), 2, 2, rounds=6, both=True, threshold=0.0)
    g, s, h, t = (np.array([r[x] for r in df.orderBy("id").collect()]) for df, x in ((res.rows, "cluster"), (res.rows, "sign"), (res.cols, "cluster"), (res.cols, "sign")))
    assert np.isclose(objective(a * s[:, None] * t[None], g, h, 1), res.objectives[-1]) and all(y <= x + 1e-9 for x, y in zip(res.objectives, res.objectives[1:], strict=False))


def test_negative_labels(spark):
    df = spark.createDataFrame([(0, 1), (1, -2), (2, 2)], "id bigint, label int")
    labels = cocluster_signed.signed_labels(df)
    assert [tuple(r) for r in labels.orderBy("id").collect()] == [(0, 0, 1), (1, 1, -1), (2, 1, 1)]
    assert [tuple(r) for r in cocluster_signed.unsigned_labels(labels).orderBy("id").collect()] == [(0, 1), (1, -2), (2, 2)]
