import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.matrix import CoordMatrix
from gridloom.operators import experiments, factor, kmeans, socialnet
from gridloom.streaming import counts


@pytest.fixture(scope="module")
def network(spark):
    rng = np.random.default_rng(8)
    a = (rng.random((12, 8)) < 0.4).astype(float)
    b = np.triu(rng.random((12, 12)) < 0.3, 1).astype(float)
    cells = lambda x: [(i, j, 1.0) for i, j in zip(*np.nonzero(x), strict=True)]
    return a, b + b.T, CoordMatrix.from_rows(spark, cells(a), a.shape), CoordMatrix.from_rows(spark, cells(b + b.T), b.shape)


def dense(m):
    a = np.zeros((m.n_rows, m.n_cols))
    for r in m.cells.collect():
        a[r["row"], r["col"]] += r["value"]
    return a


def test_splits_cover_the_memberships(network):
    a, _, ug, _ = network
    s = experiments.split_memberships(ug, 0.3, 0.1)
    assert np.array_equal(dense(s.training) + dense(s.targets), a)
    assert np.array_equal(dense(s.training_valid) + dense(s.targets_valid), dense(s.training))
    kept = dense(s.training).sum(1)
    assert np.array_equal(kept, np.floor(0.7 * a.sum(1)))


def test_predictor_metrics_against_all_candidates(network):
    _, _, ug, uu = network
    s = experiments.split_memberships(ug, 0.4, 0.1)
    got = {r["n_top"]: r for r in experiments.evaluate_predictor(uu, s, experiments.PREDICTORS["two_hop"], [2, 3]).collect()}
    t, y = dense(s.training), dense(s.targets)
    scores = t @ (t.T @ t)
    for n in (2, 3):
        precision = []
        for i in np.flatnonzero(y.sum(1)):
            cand = np.flatnonzero(t[i] == 0)
            if len(cand) < n:
                continue
            v = scores[i, cand]
            cut = np.sort(v)[::-1][n - 1]
            above, tied = cand[v > cut], cand[v == cut]
            precision.append((y[i, above].sum() + y[i, tied].sum() * (n - len(above)) / len(tied)) / n)
        assert np.isclose(got[n]["precision"], np.mean(precision))


def test_joint_katz_settings(network):
    _, _, ug, uu = network
    setting, value = experiments.learn_joint_katz(uu, experiments.split_memberships(ug, 0.3, 0.3), [0.2, 1.0], [-2], n=2)
    assert setting in [(0.2, -2), (1.0, -2)] and 0 <= value <= 1


def test_merged_layouts(network):
    a, b, ug, uu = network
    d = a.T @ a
    assert np.allclose(dense(socialnet.merged_layout(uu, ug, 0.5, 0)), np.hstack([a, 0.5 * b]))
    assert np.allclose(dense(socialnet.merged_layout(uu, ug, 0.5, 1)), np.block([[0.5 * b, a], [a.T, np.zeros((8, 8))]]))
    for kind, want in ((2, d / np.linalg.norm(a)), (3, 0.5 * d / np.linalg.norm(a)), (4, d / d.max()), (5, 0.5 * d / d.max())):
        assert np.allclose(dense(socialnet.merged_layout(uu, ug, 0.5, kind)), np.vstack([a, want]))


def test_crawl_finds_whole_rings(network):
    _, b, ug, uu = network
    got = {r["id"]: r["depth"] for r in socialnet.SocialNet(uu, ug).crawl(0, 6).collect()}
    depth, ring, d = {0: 0}, {0}, 0
    while len(depth) < 6 and ring:
        d += 1
        ring = {int(j) for i in ring for j in np.flatnonzero(b[i])} - set(depth)
        depth |= dict.fromkeys(ring, d)
    assert got == depth


def test_factorisations_improve(spark):
    rng = np.random.default_rng(9)
    a = rng.random((6, 6))
    a = a + a.T
    m = CoordMatrix.from_rows(spark, [(i, j, a[i, j]) for i in range(6) for j in range(6)], (6, 6))
    _, _, errors = factor.symmetric_trifactor([m], 2, rounds=4)
    assert errors[-1] < errors[0]
    cells = spark.createDataFrame([(i, j, k, float(rng.random())) for i in range(4) for j in range(3) for k in range(3)], "i long, j long, k long, value double")
    _, _, errors = factor.tucker(cells, (4, 3, 3), (2, 2, 2), rounds=3)
    assert errors[-1] <= errors[0]
    _, errors = factor.parafac(cells, (4, 3, 3), 2, rounds=3)
    assert errors[-1] <= errors[0] + 1e-9


def test_completion_recovers_a_low_rank_matrix(spark):
    rng = np.random.default_rng(10)
    a = np.outer(rng.random(8) + 1, rng.random(7) + 1)
    seen = rng.random(a.shape) < 0.85
    m = CoordMatrix.from_rows(spark, [(i, j, a[i, j]) for i, j in zip(*np.nonzero(seen), strict=True)], a.shape)
    u, s, v = factor.nuclear_completion(m, 1, 0.0, rounds=4)
    hidden = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(~seen), strict=True)], "row long, col long")
    got = factor.factor_scores(hidden, u, v, s).collect()
    assert max(abs(r["value"] - a[r["row"], r["col"]]) for r in got) < 0.35 * a.max()


def test_single_link_cuts_the_longest_edges(spark):
    pts = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0]
    d = spark.createDataFrame([(i, j, abs(pts[i] - pts[j])) for i in range(6) for j in range(6) if i != j], "a long, b long, d double")
    got = {r["id"]: r["cluster"] for r in kmeans.single_link(d, 6, 3).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 0, 1, 1, 2]


def test_single_link_of_points_is_that_of_all_pairs(spark):
    """Blocks of a few points, ties and points without mass in a place, against Kruskal over all pairs."""
    rng = np.random.default_rng(4)
    x = rng.dirichlet(np.ones(5), 40)
    x[:3, 0] = 0
    x[10:14] = x[9]
    x /= x.sum(axis=1, keepdims=True)
    pts = spark.createDataFrame([(i * 2, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")

    def kl(p, q):
        return sum(a * np.log(a / b) if b > 0 else np.inf for a, b in zip(p, q, strict=True) if a > 0)

    edges = sorted((round(min(kl(x[i], x[j]), kl(x[j], x[i])), 12), i * 2, j * 2) for i in range(40) for j in range(i + 1, 40))
    root = {i * 2: i * 2 for i in range(40)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    chosen = []
    for d, i, j in edges:
        if find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
            chosen.append((d, i, j))
    tree = kmeans.point_tree(pts, 80, block=7).collect()
    assert np.allclose(sorted(r["value"] for r in tree), [d for d, _, _ in chosen])
    root.update({i: i for i in root})
    for _, i, j in sorted(chosen)[: 40 - 4]:
        root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["id"]: r["cluster"] for r in kmeans.single_link_of_points(pts, 4).collect()}
    names = {c: k for k, c in enumerate(sorted({find(i) for i in root}))}
    assert got == {i: names[find(i)] for i in root}


def test_clusters_are_described(spark):
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    assert tuple(kmeans.cluster_sizes(c).first()) == (2, 2, 1, 1.5)
    assert [r["id"] for r in kmeans.cluster_members(c, 1).collect()] == [3] and kmeans.cluster_members(c, 9).count() == 0


def test_program(spark, tmp_path):
    rng = np.random.default_rng(11)
    a = np.kron([[9, 1], [1, 9]], np.ones((4, 3))) + rng.random((8, 6))
    order = rng.permutation(8)
    rows = [(int(i), int(j), float(a[order[i], j])) for i in range(8) for j in range(6)]
    spark.createDataFrame(rows, "row long, col long, value double").write.parquet(str(tmp_path / "m"))
    (tmp_path / "classes").write_text("\n".join(["8", *[str(order[i] // 4) for i in range(8)]]))
    for algorithm in ("mssr1", "euclid"):
        out = cli.run(spark, [str(tmp_path / "m"), "-a", algorithm, "-R", "2", "-C", "2", "-n", "3", "-K", str(tmp_path / "classes"), "-O", str(tmp_path / algorithm)])
        assert out["purity"] == 1.0 and out["best"] <= out["mean"]
        assert spark.read.parquet(str(tmp_path / algorithm)).filter("side = 'row'").select(F.sum("size")).first()[0] == 8


def test_stream_counts(spark, tmp_path):
    links = [(0, 1), (1, 2), (2, 0), (3, 0)]
    for k, part in enumerate((links[:2], links[2:])):
        spark.createDataFrame(part, "row long, col long").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("row long, col long").parquet(str(tmp_path / "in" / "*"))
    counts.degree_totals(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["id"]: r["degree"] for r in counts.read_degrees(spark, str(tmp_path / "out")).collect()} == {0: 3, 1: 2, 2: 2, 3: 1}


def test_windowed_counts_wait_for_late_rows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 09:00:00", "b"), ("2024-01-01 20:00:00", "b")]
    spark.createDataFrame(rows, "t string, kind string").selectExpr("cast(t as timestamp) ts", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = counts.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.sql("SELECT * FROM windows").collect()} == {("a", 2), ("b", 1)}


def test_linked_factors_never_rise(network):
    a, b, ug, uu = network
    u, g, l1, l2, history = factor.linked_factors(ug, uu, 2, weight=0.5, reg=0.1, rounds=3)
    assert all(y <= x + 1e-9 for x, y in zip(history, history[1:], strict=False)) and history[-1] < history[0]
    x, y = (np.array([r["vec"] for r in f.orderBy("id").collect()]) for f in (u, g))
    want = ((a - x @ l1 @ y.T) ** 2).sum() + 0.5 * ((b - x @ l2 @ x.T) ** 2).sum() + 0.1 * sum((m**2).sum() for m in (x, y, l1, l2))
    assert np.isclose(want, history[-1])


def test_nuclear_completion_scores_every_cell(spark):
    from helpers import SF

    from gridloom.plans import inputs, registry

    want = {(r["row"], r["col"]) for r in inputs.user_part(spark, SF).cells.collect()}
    got = registry.QUERIES["nuclear_completion"](spark, SF).collect()
    assert len(got) == len(want) and {(r["row"], r["col"]) for r in got} == want


def test_networks_of_shared_factors(spark):
    uu, ug = experiments.artificial_network(spark, 4, 30, 20, 0.12)
    assert uu.cells.count() == 2 * int(0.12 * 30 * 29 / 2) and ug.cells.count() == int(0.12 * 30 * 20)


def test_a_chain_is_recovered_from_many_samples(spark):
    curve = experiments.structure_recovery(spark, "chain", 3, [800], trials=1).curve
    assert curve == [(800, 1.0, 0.0)]


def test_two_hop_scores_in_blocks(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((20, 12)) < 0.25) * rng.integers(1, 4, (20, 12)).astype(float)
    m = CoordMatrix.from_rows(spark, [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], a.shape)
    full = a @ (a.T @ a)
    reached = {(i, j): full[i, j] for i, j in zip(*np.nonzero(full), strict=True) if not a[i, j]}
    for most in (1 << 20, 64 * 20):  # one block, and several
        got = {(r["row"], r["col"]): r["value"] for r in socialnet.two_hop_scores(m, most).collect()}
        assert got == reached
        best = {(r["row"], r["place"]): (r["col"], r["value"]) for r in socialnet.recommend(m, 3).collect()}
        for i in range(20):
            want = sorted(((-v, j) for (r, j), v in reached.items() if r == i))[:3]
            assert [best.get((i, k + 1)) for k in range(3)] == [(j, -v) for v, j in want] + [None] * (3 - len(want))
    parts = socialnet.two_hop_scores(m, 64 * 20, best=2)
    assert parts.groupBy("row").count().agg(F.max("count")).first()[0] > 2  # so many of each block


def test_places_of_a_value_that_most_rows_share(spark):
    from gridloom.matrix import numbered

    rows = [(i, None if i % 50 == 0 else 1.0 if i % 3 else float(i % 7)) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(5)
    got = {r["id"]: r["place"] for r in numbered(df, "v", "id", "place").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(order)}
    ids = numbered(df, "v", "id", "place")
    assert ids.count() == 700 and numbered(df.limit(0), "v", "id", "place").count() == 0


def test_program_with_reversed_rows_and_chains(spark, tmp_path):
    rng = np.random.default_rng(12)
    a = rng.normal(size=(6, 5))
    spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(5)], "row long, col long, value double").write.parquet(str(tmp_path / "m"))
    plain = cli.run(spark, [str(tmp_path / "m"), "-a", "mssr1", "-i", "3", "-O", str(tmp_path / "plain")])
    turned = cli.run(spark, [str(tmp_path / "m"), "-a", "mssr1", "-i", "3", "-r", "rows", "-O", str(tmp_path / "turned")])
    signs = spark.read.parquet(str(tmp_path / "turned")).filter("side = 'row'").select(F.explode("signs")).distinct().collect()
    assert {r[0] for r in signs} <= {1, -1} and turned["best"] > 0
    chained = cli.run(spark, [str(tmp_path / "m"), "-a", "mssr1", "-i", "3", "-l", "2", "-O", str(tmp_path / "chained")])
    assert chained["best"] <= plain["best"] + 1e-9
    ids = spark.read.parquet(str(tmp_path / "chained")).groupBy("side").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")).collect()
    assert {r["side"]: r["ids"] for r in ids} == {"row": list(range(6)), "col": list(range(5))}


def test_blocks_of_points_grow_with_the_points(monkeypatch, spark):
    """Each point is exchanged once for each block: 12 blocks up to the largest size, then as few as that allows; small tables keep one block."""
    assert [kmeans.block_size(n) for n in (0, 900, 60_000, 10**7)] == [1000, 1000, 5000, 16_384]
    taken, blocked = [], kmeans._blocked
    monkeypatch.setattr(kmeans, "_blocked", lambda points, size: taken.append(size) or blocked(points, size))
    monkeypatch.setattr(kmeans, "LEAST_BLOCK", 5)
    rows = [(i, [x / 10, 1 - x / 10]) for i, x in enumerate([1.0, 1.1, 8.0, 8.2, 4.0, 4.3] * 20)]
    kmeans.point_tree(spark.createDataFrame(rows, "id long, vec array<double>"), 120)
    assert set(taken) == {10}


def test_clustered_scores_in_parts_are_those_of_whole_blocks(spark):
    """Blocks dealt to several parts and packs, one of them of fewer rows than k, against dense factors; no task gets a whole block."""
    rng = np.random.default_rng(3)
    a = (rng.random((60, 50)) < 0.12).astype(float)
    uc, gc = np.where(np.arange(60) < 2, 2, np.arange(60) % 2), np.where(np.arange(50) < 6, 2, np.arange(50) % 2)
    a[:2, :6] = 1
    a[1, 2] = 0
    m = CoordMatrix.from_rows(spark, [(i, j, 1.0) for i, j in zip(*np.nonzero(a), strict=True)], a.shape)
    clusters = lambda x: spark.createDataFrame([(i, int(c)) for i, c in enumerate(x)], "id long, cluster int")
    scores = experiments.clustered_svd_scores(m, clusters(uc), clusters(gc), 3, part=100, pack=8)
    assert "FlatMapGroupsInPandas" not in scores.cells._jdf.queryExecution().executedPlan().toString()
    want = {}
    for c in range(3):
        r, q = np.flatnonzero(uc == c), np.flatnonzero(gc == c)
        b = a[np.ix_(r, q)]
        r, q = r[b.any(1)], q[b.any(0)]
        x, s, y = np.linalg.svd(a[np.ix_(r, q)], full_matrices=False)
        fit = (x[:, :3] * s[:3]) @ y[:3]
        want |= {(int(i), int(j)): fit[n, o] for n, i in enumerate(r) for o, j in enumerate(q)}
    got = {(r["row"], r["col"]): r["value"] for r in scores.cells.collect()}
    assert set(got) == set(want) and max(abs(got[p] - want[p]) for p in got) < 1e-6


@pytest.mark.parametrize("most_held", [1, 1 << 20])
def test_point_tree_has_no_circle_where_many_distances_are_equal(spark, monkeypatch, most_held):
    """Equal points and equal distances, infinite ones too; components as tables and as arrays, which take no rounds of joins."""
    rng = np.random.default_rng(6)
    kinds = np.array([[0.5, 0.5, 0, 0], [0.25, 0.75, 0, 0], [0.75, 0.25, 0, 0], [0, 0, 0.5, 0.5]])
    pts = spark.createDataFrame([(i, [float(v) for v in kinds[k]]) for i, k in enumerate(rng.integers(0, 4, 30))], "id long, vec array<double>")
    if most_held > 30:
        monkeypatch.setattr(kmeans, "components", lambda *_: pytest.fail("joined"))
    tree = [tuple(r) for r in kmeans.point_tree(pts, 30, block=8, most_held=most_held).collect()]
    low = np.arange(30)
    kmeans._join(low, np.array([t[0] for t in tree]), np.array([t[1] for t in tree]))
    assert len(tree) == 29 and (low == 0).all() and sum(t[2] == 0 for t in tree) == 26 and sum(np.isinf(t[2]) for t in tree) == 1


def test_svd_scores_exchange_no_partial_products_and_splits_are_stored(network, monkeypatch):
    a, _, ug, uu = network
    whole, calls = CoordMatrix.multiply, []
    monkeypatch.setattr(CoordMatrix, "multiply", lambda x, y: calls.append(x.n_rows) or whole(x, y))
    got = experiments.svd_predictor(2)(uu, ug)
    u, s, v = factor.svd(ug, 2)
    full = lambda f, n: np.array([x["vec"] for x in sorted(f.collect(), key=lambda r: r["id"])]).reshape(n, 2)
    reach = a @ a.T @ a > 0
    assert np.allclose(dense(got), np.where(reach, (full(u, 12) * s) @ full(v, 8).T, 0)) and got.cells.count() == reach.sum()
    assert calls == [8]  # of groups alone
    splits = experiments.split_memberships(ug, 0.3, 0.1)
    held = splits.stored()
    for name in ("training", "targets"):
        x, y = getattr(held, name), getattr(splits, name)
        assert np.array_equal(dense(x), dense(y)) and "Scan ExistingRDD" in x.cells._jdf.queryExecution().executedPlan().toString()
