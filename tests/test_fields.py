"""Fields of several states against enumeration and against separate fits."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fields, learn


def small(seed=1, nodes=3, states=3):
    rng = np.random.default_rng(seed)
    return fields.Field(rng.normal(size=(nodes, states)) * 0.5, {(a, a + 1): rng.normal(size=(states, states)) * 0.7 for a in range(nodes - 1)})


def energy(f, x):
    return sum(f.own[i, x[i]] for i in range(f.nodes)) + sum(b[x[i], x[j]] for (i, j), b in f.blocks.items())


def exact(f):
    p = {x: np.exp(energy(f, x)) for x in product(range(f.states), repeat=f.nodes)}
    total = sum(p.values())
    return {x: v / total for x, v in p.items()}


def conditional(f, x, i):
    e = np.array([np.exp(energy(f, (*x[:i], s, *x[i + 1 :]))) for s in range(f.states)])
    return e / e.sum()


def observed(spark, rows):
    return spark.createDataFrame([(str(k), [int(v) for v in x]) for k, x in enumerate(rows)], "key string, x array<int>")


def test_conditionals_and_pseudo_likelihood(spark):
    f = small()
    rows = [tuple(np.random.default_rng(k).integers(0, 3, 3)) for k in range(30)]
    rows += rows[:5]
    df = observed(spark, rows)
    for r in fields.conditionals(df, f).collect():
        assert r["n"] == rows.count(tuple(r["x"])) and all(np.allclose(r["p"][i], conditional(f, tuple(r["x"]), i)) for i in range(3))
    want = np.mean([sum(-np.log(conditional(f, x, i)[x[i]]) for i in range(3)) for x in rows])
    assert np.isclose(fields.pseudo_likelihood(df, f).first()["loss"], want)
    uniform = fields.Field(np.zeros((3, 3)), {})
    assert np.allclose([p for r in fields.conditionals(df, uniform).collect() for q in r["p"] for p in q], 1 / 3)


def test_classes_part_linked_variables():
    f = small(nodes=6)
    assert f.classes() == [[0, 2, 4], [1, 3, 5]]
    ring = fields.Field(np.zeros((5, 2)), {(a, b): np.zeros((2, 2)) for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (0, 4))})
    assert all(not {(i, j), (j, i)} & set(ring.blocks) for c in ring.classes() for i in c for j in c)
    assert np.allclose(f.negated().blocks[0, 1], -f.blocks[0, 1])


def test_gibbs_reaches_the_exact_distribution(spark):
    f = small(seed=4)
    starts = spark.range(3000).select(F.col("id").cast("string").alias("key"), F.array(*[F.lit(0)] * 3).alias("x"))
    got = {tuple(r["x"]): r["n"] / 3000 for r in fields.gibbs(starts, f, 6).groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert max(abs(got.get(x, 0) - p) for x, p in exact(f).items()) < 0.03
    again = fields.gibbs(starts.repartition(7), f, 1).collect()
    assert {r["key"]: r["x"] for r in again} == {r["key"]: r["x"] for r in fields.gibbs(starts, f, 1).collect()}


def test_tables_agree_with_rows(spark):
    f = small(seed=2)
    rows = [tuple(np.random.default_rng(k).integers(0, 3, 3)) for k in range(6)]
    states = spark.createDataFrame([(c, i, int(x[i])) for c, x in enumerate(rows) for i in range(3)], "chain bigint, node bigint, state int")
    own = spark.createDataFrame([(i, [float(v) for v in f.own[i]]) for i in range(3)], "node bigint, own array<double>")
    edges = spark.createDataFrame([(a, b, [float(v) for v in m.ravel()]) for (a, b), m in f.blocks.items()], "a bigint, b bigint, block array<double>")
    t = fields.FieldTables(own, edges, 3)
    for r in fields.table_conditionals(states, t).collect():
        assert np.allclose(r["p"], conditional(f, rows[r["chain"]], r["node"]))
    colours = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "node bigint, colour int")
    got = {(r["chain"], r["node"]): r["state"] for r in fields.table_gibbs(states, t, colours, 2).collect()}
    wide = fields.gibbs(observed(spark, rows), f, 2)  # the keys are the chains' numbers
    assert got == {(int(r["key"]), i): r["x"][i] for r in wide.collect() for i in range(3)}


def test_colouring(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2))]
    nodes = spark.range(42).select(F.col("id").alias("node"))
    got = {r["node"]: r["colour"] for r in fields.colouring(spark.createDataFrame(pairs, "a bigint, b bigint"), nodes).collect()}
    assert len(got) == 42 and all(got[a] != got[b] for a, b in pairs if a != b)
    degree = {v: len({a + b - v for a, b in pairs if v in (a, b) and a != b}) for v in got}
    assert all(got[v] <= degree[v] for v in got)
    none = fields.colouring(spark.createDataFrame([], "a bigint, b bigint"), nodes)
    assert {r["colour"] for r in none.collect()} == {0}


@pytest.fixture(scope="module")
def sampled(spark):
    f = fields.generated(np.array([[0, 1, 0, 0], [1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]]), 3, 0.0, 2.0, "normal", seed=1)
    starts = spark.range(1500).select(F.col("id").cast("string").alias("key"), F.array(*[(F.col("id") % 3).cast("int")] * 4).alias("x"))
    return f, spark.createDataFrame(fields.gibbs(starts, f, 4).collect(), "key string, x array<int>")


def test_one_pass_gives_the_gradient_of_each_regression(spark, sampled):
    _, df = sampled
    rng = np.random.default_rng(1)
    w = rng.normal(size=(9, 8)) * 0.3
    for i in range(4):
        w[1 + 2 * i : 3 + 2 * i, 2 * i : 2 * i + 2] = 0
    counted = df.groupBy("x").agg(F.count("*").alias("n"))
    sums = {(r["i"], r["j"]): r["v"] / 1500 for r in fields.neighbourhood_sums(counted, w, 4, 3).collect()}
    for i in range(4):
        others = [j for j in range(4) if j != i]
        flat = df.select(F.col("x")[i].alias("y"), *[(F.col("x")[j] == t).cast("double").alias(f"f{j}_{t}") for j in others for t in range(2)])
        at = [0, *[1 + 2 * j + t for j in others for t in range(2)]]
        loss, g = learn.multinomial_loss(flat, flat.columns[1:], "y", w[at][:, 2 * i : 2 * i + 2].T)
        assert np.isclose(loss, sums[-1, i])
        assert np.allclose(g, [[sums[a, 2 * i + s] for a in at] for s in range(2)])


def test_path_equals_separate_fits_and_finds_the_edges(spark, sampled):
    _, df = sampled
    steps = fields.neighbourhood_path(df, 4, 3, [0.02, 2.0], rounds=150, tolerance=1e-6)
    assert [s.penalty for s in steps] == [2.0, 0.02]
    assert np.all(fields.block_norms(steps[0], 4, 3) == 0)
    norms = fields.block_norms(steps[1], 4, 3)
    linked = {(a, b) for a in range(4) for b in range(4) if a != b and norms[a, b] > 0.05}
    assert linked == {(0, 1), (1, 0), (1, 2), (2, 1)}
    i, others = 1, [0, 2, 3]
    flat = df.select(F.col("x")[i].alias("y"), *[(F.col("x")[j] == t).cast("double").alias(f"f{j}_{t}") for j in others for t in range(2)])
    own = steps[1].parameters[[0, *[1 + 2 * j + t for j in others for t in range(2)]]][:, 2 * i : 2 * i + 2].T
    value = lambda b: learn.multinomial_loss(flat, flat.columns[1:], "y", b)[0] + 0.02 * learn.group_penalty(b, [[1, 2], [3, 4], [5, 6]])
    alone = learn.group_lasso(flat, flat.columns[1:], "y", 3, [[0, 1], [2, 3], [4, 5]], 0.02, rounds=80)
    assert value(own) <= value(alone) + 1e-5 and np.allclose(own, alone, atol=0.05)
