"""Latent factors: truncated SVD and its predictors, singular value projection, non-negative factorisations, tensors.

Tall factors live in DataFrames as (id, vec); only k x k matrices and factor spaces reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.divergence import dot
from ..matrix import CoordMatrix, linear_index
from ..session import cut


def _with_vectors(cells: DataFrame, factors: DataFrame, axis: str) -> DataFrame:
    return cells.join(factors.select(F.col("id").alias(axis), "vec"), axis)


def times_factors(m: CoordMatrix, factors: DataFrame, k: int) -> DataFrame:
    """A F as (id, vec): sums of scaled factor rows, component by component so partial sums stay small."""
    j = _with_vectors(m.cells, factors, "col")
    sums = j.groupBy(F.col("row").alias("id")).agg(*[F.sum(F.col("value") * F.get("vec", F.lit(c))).alias(f"v{c}") for c in range(k)])
    return sums.select("id", F.array(*[F.col(f"v{c}") for c in range(k)]).alias("vec"))


def gram(factors: DataFrame, k: int, other: DataFrame | None = None) -> np.ndarray:
    """F'F, or F'G for rows with equal ids; k x k values reach the driver."""
    if other is None:
        j, a, b = factors, "vec", "vec"
    else:
        j, a, b = factors.join(other.select("id", F.col("vec").alias("__o")), "id"), "vec", "__o"
    r = j.agg(*[F.sum(F.get(a, F.lit(x)) * F.get(b, F.lit(y))).alias(f"g{x}_{y}") for x in range(k) for y in range(k)]).first()
    return np.array([[r[f"g{x}_{y}"] or 0.0 for y in range(k)] for x in range(k)])


def rotate(factors: DataFrame, w: np.ndarray) -> DataFrame:
    """F W for a small W."""
    cols = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(v)) for v in w[:, c]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for c in range(w.shape[1])]
    return factors.select("id", F.array(*cols).alias("vec"))


def orthonormal(factors: DataFrame, k: int) -> DataFrame:
    """Columns made orthonormal through the Cholesky factor of F'F, twice for accuracy."""
    for _ in range(2):
        g = gram(factors, k)
        w, v = np.linalg.eigh(g)
        keep = w > max(w.max(), 0) * 1e-13
        root = np.where(keep, 1 / np.sqrt(np.where(keep, w, 1.0)), 0.0)
        factors = cut(rotate(factors, v * root))
    return factors


def start_factors(m: CoordMatrix, k: int, axis: str = "col") -> DataFrame:
    """(id, vec) with entries from an arithmetic key, so runs repeat."""
    n = m.n_cols if axis == "col" else m.n_rows
    entry = lambda c: (F.pmod((F.col("id") + 1) * F.lit(7919 + 104729 * (c + 1)) + F.col("id") * F.col("id") * F.lit(31 + c), F.lit(1000003)) / 1000003.0) - 0.5
    return m.cells.sparkSession.range(n).select("id", F.array(*[entry(c) for c in range(k)]).alias("vec"))


def svd(m: CoordMatrix, k: int, rounds: int = 8) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """U, singular values, V of the k largest by subspace iteration: two products and a k x k problem a round."""
    t, v = m.transpose(), orthonormal(start_factors(m, k), k)
    for _ in range(rounds):
        v = orthonormal(times_factors(t, cut(times_factors(m, v, k)), k), k)
    av = cut(times_factors(m, v, k))
    w, e = np.linalg.eigh(gram(av, k))
    order = np.argsort(-w)
    s = np.sqrt(np.maximum(w[order], 0))
    e = e[:, order]
    scale = np.where(s > 0, 1 / np.where(s > 0, s, 1), 0.0)
    return rotate(av, e * scale), s, rotate(v, e)


def symmetric_eigen(m: CoordMatrix, k: int, rounds: int = 12) -> tuple[np.ndarray, DataFrame]:
    """The k eigenvalues of largest size with their signs, and eigenvectors: V'MV is diagonalised on the driver."""
    v = orthonormal(start_factors(m, k), k)
    for _ in range(rounds):
        v = orthonormal(times_factors(m, v, k), k)
    w, e = np.linalg.eigh(gram(v, k, times_factors(m, v, k)))
    order = np.argsort(-np.abs(w))
    return w[order], rotate(v, e[:, order])


def factor_scores(cells: DataFrame, left: DataFrame, right: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(row, col, value) of left diag(w) right' at the positions of ``cells``."""
    if weights is not None:
        left = rotate(left, np.diag(weights))
    a, b = left.select(F.col("id").alias("row"), F.col("vec").alias("__a")), right.select(F.col("id").alias("col"), F.col("vec").alias("__b"))
    return cells.select("row", "col").join(a, "row").join(b, "col").select("row", "col", dot(F.col("__a"), F.col("__b")).alias("value"))


def katz_in_factors(values: np.ndarray, beta: float, terms: int = 3) -> np.ndarray:
    """Eigenvalues of the truncated Katz matrix: sum of (beta lambda)^i."""
    return sum((beta * values) ** i for i in range(1, terms + 1))


def sparsify(scores: CoordMatrix, keep: int) -> CoordMatrix:
    """The ``keep`` largest cells, equal ones in column order."""
    return CoordMatrix(scores.cells.orderBy(F.desc("value"), linear_index(scores.n_rows)).limit(keep), scores.n_rows, scores.n_cols)


def singular_value_projection(m: CoordMatrix, unknown: DataFrame, k: int, rounds: int = 5) -> CoordMatrix:
    """Refill the unknown cells (row, col) from rank-k scores, again and again; known cells stay."""
    filled = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    for _ in range(rounds):
        u, s, v = svd(filled, k, rounds=3)
        guess = factor_scores(unknown, u, v, s)
        known = m.cells.join(unknown.select("row", "col"), ["row", "col"], "left_anti")
        filled = CoordMatrix(cut(known.unionByName(guess)), m.n_rows, m.n_cols)
    return filled


def soft_threshold(m: CoordMatrix, k: int, tau: float) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Proximal step of the nuclear norm within rank k."""
    u, s, v = svd(m, k)
    return u, np.maximum(s - tau, 0), v


def nonnegative_start(m: CoordMatrix, k: int, axis: str) -> DataFrame:
    return start_factors(m, k, axis).select("id", F.transform("vec", lambda v: v + 0.6).alias("vec"))


def _elementwise(a: DataFrame, f, *others: DataFrame) -> DataFrame:
    j = a
    for n, o in enumerate(others):
        j = j.join(o.select("id", F.col("vec").alias(f"__{n}")), "id", "left")
    return j.select("id", f("vec", *[f"__{n}" for n in range(len(others))]).alias("vec"))


def nmf(m: CoordMatrix, k: int, rounds: int = 10, divergence: str = "ls", pad: float = 1e-9) -> tuple[DataFrame, DataFrame, list[float]]:
    """B, C and the objective by round, A ~ B C': multiplicative updates for squared distance (ls) or KL (kl)."""
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    t = m.transpose()
    b, c = cut(nonnegative_start(m, k, "row")), cut(nonnegative_start(m, k, "col"))
    zero = F.array(*[F.lit(0.0)] * k)
    history = []

    def ratio(x: CoordMatrix, mine: DataFrame, other: DataFrame) -> tuple[CoordMatrix, DataFrame]:
        fit = factor_scores(x.cells, mine, other).withColumnRenamed("value", "__f")
        return CoordMatrix(x.cells.join(fit, ["row", "col"]).select("row", "col", (F.col("value") / (F.col("__f") + pad)).alias("value")), x.n_rows, x.n_cols), other

    for _ in range(rounds):
        for side in (0, 1):
            x, mine, other = (m, b, c) if side == 0 else (t, c, b)
            if divergence == "ls":
                top, below = times_factors(x, other, k), rotate(mine, gram(other, k))
            else:
                top = times_factors(ratio(x, mine, other)[0], other, k)
                total = other.agg(*[F.sum(F.get("vec", F.lit(i))).alias(f"t{i}") for i in range(k)]).first()
                below = mine.select("id", F.array(*[F.lit(float(total[i] or 0.0)) for i in range(k)]).alias("vec"))
            new = _elementwise(mine, lambda v, p, q: F.transform(F.arrays_zip(F.col(v).alias("a"), F.coalesce(F.col(p), zero).alias("b"), F.col(q).alias("c")), lambda s: s["a"] * s["b"] / (s["c"] + pad)), top, below)
            b, c = (cut(new), c) if side == 0 else (b, cut(new))
        history.append(nmf_objective(m, b, c, k, divergence))
    return b, c, history


def nmf_objective(m: CoordMatrix, b: DataFrame, c: DataFrame, k: int, divergence: str = "ls") -> float:
    """|A - BC'|^2 or KL(A, BC'), absent cells counted as zeros in closed form."""
    fit = factor_scores(m.cells, b, c).withColumnRenamed("value", "__f")
    j = m.cells.join(fit, ["row", "col"])
    if divergence == "ls":
        own = j.agg(F.sum(F.col("value") * F.col("value") - 2 * F.col("value") * F.col("__f"))).first()[0] or 0.0
        return float(own + np.trace(gram(b, k) @ gram(c, k)))
    own = j.agg(F.sum(F.when(F.col("value") > 0, F.col("value") * F.log(F.col("value") / (F.col("__f") + 1e-9))).otherwise(0.0) - F.col("value"))).first()[0] or 0.0
    sums = [np.array([r or 0.0 for r in x.agg(*[F.sum(F.get("vec", F.lit(i))) for i in range(k)]).first()]) for x in (b, c)]
    return float(own + sums[0] @ sums[1])


def nonnegative_als(m: CoordMatrix, k: int, rounds: int = 5, ridge: float = 1e-9) -> tuple[DataFrame, DataFrame, list[float]]:
    """Projected alternating least squares: k x k normal equations on the driver, negative entries set to 0."""
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    t, b, c, history = m.transpose(), cut(nonnegative_start(m, k, "row")), cut(nonnegative_start(m, k, "col")), []
    for _ in range(rounds):
        b = cut(_clipped(times_factors(m, c, k), gram(c, k) + ridge * np.eye(k)))
        c = cut(_clipped(times_factors(t, b, k), gram(b, k) + ridge * np.eye(k)))
        history.append(nmf_objective(m, b, c, k))
    return b, c, history


def _clipped(top: DataFrame, g: np.ndarray) -> DataFrame:
    return rotate(top, np.linalg.inv(g)).select("id", F.transform("vec", lambda v: F.greatest(v, F.lit(0.0))).alias("vec"))


def masked_nmf(m: CoordMatrix, k: int, rounds: int = 10, pad: float = 1e-9) -> tuple[DataFrame, DataFrame, list[float]]:
    """Only the cells present count; absent ones are unknown."""
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    b, c, history = cut(nonnegative_start(m, k, "row")), cut(nonnegative_start(m, k, "col")), []
    zero = F.array(*[F.lit(0.0)] * k)
    for _ in range(rounds):
        for side in (0, 1):
            x, mine, other = (m, b, c) if side == 0 else (m.transpose(), c, b)
            fit = CoordMatrix(factor_scores(x.cells, mine, other), x.n_rows, x.n_cols)
            top, below = times_factors(x, other, k), times_factors(fit, other, k)
            new = _elementwise(mine, lambda v, p, q: F.transform(F.arrays_zip(F.col(v).alias("a"), F.coalesce(F.col(p), zero).alias("b"), F.coalesce(F.col(q), zero).alias("c")), lambda s: s["a"] * s["b"] / (s["c"] + pad)), top, below)
            b, c = (cut(new), c) if side == 0 else (b, cut(new))
        fit = factor_scores(m.cells, b, c).withColumnRenamed("value", "__f")
        history.append(m.cells.join(fit, ["row", "col"]).agg(F.sum((F.col("value") - F.col("__f")) ** 2)).first()[0] or 0.0)
    return b, c, history


def linked_objective(user_group: CoordMatrix, user_user: CoordMatrix, users: DataFrame, groups: DataFrame, l1: np.ndarray, l2: np.ndarray, weight: float, reg: float) -> float:
    """|UG - U L1 G'|^2 + w |UU - U L2 U'|^2 + reg (|U|^2 + |G|^2 + |L1|^2 + |L2|^2)."""

    def part(x: CoordMatrix, left: DataFrame, middle: np.ndarray, right: DataFrame) -> float:
        k = middle.shape[0]
        bent = rotate(left, middle)
        fit = factor_scores(x.cells, bent, right).withColumnRenamed("value", "__f")
        own = x.cells.join(fit, ["row", "col"]).agg(F.sum(F.col("value") * F.col("value") - 2 * F.col("value") * F.col("__f"))).first()[0] or 0.0
        return float(own + np.trace(gram(bent, k) @ gram(right, k)))

    k = l1.shape[0]
    norms = float(np.trace(gram(users, k)) + np.trace(gram(groups, k)) + (l1**2).sum() + (l2**2).sum())
    return part(user_group, users, l1, groups) + weight * part(user_user, users, l2, users) + reg * norms


def tensor_times_factors(cells: DataFrame, mode: str, factors: dict[str, DataFrame], k: int) -> DataFrame:
    """Matricised tensor times Khatri-Rao product. ``cells``: (i, j, k, value); ``factors``: by mode; returns (id, vec) of ``mode``."""
    j = cells
    others = [x for x in ("i", "j", "k") if x != mode]
    for o in others:
        j = j.join(factors[o].select(F.col("id").alias(o), F.col("vec").alias(f"__{o}")), o)
    sums = j.groupBy(F.col(mode).alias("id")).agg(*[F.sum(F.col("value") * F.get(f"__{others[0]}", F.lit(c)) * F.get(f"__{others[1]}", F.lit(c))).alias(f"v{c}") for c in range(k)])
    return sums.select("id", F.array(*[F.col(f"v{c}") for c in range(k)]).alias("vec"))


def parafac(cells: DataFrame, shape: tuple[int, int, int], k: int, rounds: int = 5, pad: float = 1e-9) -> tuple[dict[str, DataFrame], list[float]]:
    """Non-negative PARAFAC of (i, j, k, value) by multiplicative updates; factors by mode and the squared error by round."""
    cells = cut(cells)
    spark, zero = cells.sparkSession, F.array(*[F.lit(0.0)] * k)
    factors = {x: cut(nonnegative_start(CoordMatrix(spark.createDataFrame([], "row bigint, col bigint, value double"), n, n), k, "row")) for x, n in zip("ijk", shape, strict=True)}
    square, history = cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0, []
    for _ in range(rounds):
        for mode in "ijk":
            others = [x for x in "ijk" if x != mode]
            g = gram(factors[others[0]], k) * gram(factors[others[1]], k)
            top, below = tensor_times_factors(cells, mode, factors, k), rotate(factors[mode], g)
            factors[mode] = cut(_elementwise(factors[mode], lambda v, p, q: F.transform(F.arrays_zip(F.col(v).alias("a"), F.coalesce(F.col(p), zero).alias("b"), F.col(q).alias("c")), lambda s: s["a"] * s["b"] / (s["c"] + pad)), top, below))
        inner = gram(factors["k"], k, tensor_times_factors(cells, "k", factors, k))
        whole = (gram(factors["i"], k) * gram(factors["j"], k) * gram(factors["k"], k)).sum()
        history.append(float(square - 2 * np.trace(inner) + whole))
    return factors, history


def power_weights(powers: list[CoordMatrix], target: CoordMatrix, ridge: float = 0.0, nonnegative: bool = False) -> np.ndarray:
    """Weights w that bring sum w_i M_i nearest to the target: Gram values by joins, k x k solve on the driver."""
    k = len(powers)
    g, y = np.zeros((k, k)), np.zeros(k)
    inner = lambda a, b: a.hadamard(b).cells.agg(F.sum("value")).first()[0] or 0.0
    for i in range(k):
        y[i] = inner(powers[i], target)
        for j in range(i, k):
            g[i, j] = g[j, i] = inner(powers[i], powers[j])
    if nonnegative:
        from .optimise import nnls_gram

        return nnls_gram(g + ridge * np.eye(k), y)
    return np.linalg.solve(g + ridge * np.eye(k), y)


def symmetric_trifactor(slices: list[CoordMatrix], k: int, rounds: int = 10, pad: float = 1e-9) -> tuple[DataFrame, list[np.ndarray], list[float]]:
    """A_i ~ P L_i P' with non-negative P and L_i for symmetric slices, by multiplicative updates; P, the L_i, and the squared error by round."""
    slices = [CoordMatrix(cut(m.cells), m.n_rows, m.n_cols) for m in slices]
    p = cut(nonnegative_start(slices[0], k, "row"))
    ls = [np.eye(k) + 0.1 for _ in slices]
    squares = [m.cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0 for m in slices]
    zero, history = F.array(*[F.lit(0.0)] * k), []
    for _ in range(rounds):
        g = gram(p, k)
        top = None
        below = np.zeros((k, k))
        for m, mid in zip(slices, ls, strict=True):
            own = rotate(times_factors(m, p, k), mid)
            top = own if top is None else top.unionByName(own)
            below += mid @ g @ mid
        top = top.groupBy("id").agg(*[F.sum(F.get("vec", F.lit(c))).alias(f"v{c}") for c in range(k)]).select("id", F.array(*[F.col(f"v{c}") for c in range(k)]).alias("vec"))
        bottom = rotate(p, below)
        p = cut(_elementwise(p, lambda v, a, b: F.transform(F.arrays_zip(F.col(v).alias("a"), F.coalesce(F.col(a), zero).alias("b"), F.col(b).alias("c")), lambda s: s["a"] * F.sqrt(F.sqrt(s["b"] / (s["c"] + pad)))), top, bottom))
        g, error = gram(p, k), 0.0
        for i, m in enumerate(slices):
            pap = gram(p, k, times_factors(m, p, k))
            ls[i] = ls[i] * np.sqrt(pap / (g @ ls[i] @ g + pad))
            error += squares[i] - 2 * float((pap * ls[i]).sum()) + float(np.trace(ls[i] @ g @ ls[i].T @ g))
        history.append(error)
    return p, ls, history


def tucker(cells: DataFrame, shape: tuple[int, int, int], ranks: tuple[int, int, int], rounds: int = 5, pad: float = 1e-9) -> tuple[dict[str, DataFrame], np.ndarray, list[float]]:
    """Non-negative Tucker of (i, j, k, value): factors by mode, the core, and the squared error by round, by multiplicative updates."""
    cells, spark = cut(cells), cells.sparkSession
    empty = spark.createDataFrame([], "row bigint, col bigint, value double")
    size = dict(zip("ijk", ranks, strict=True))
    factors = {x: cut(nonnegative_start(CoordMatrix(empty, n, n), size[x], "row")) for x, n in zip("ijk", shape, strict=True)}
    core = np.full(ranks, 1.0) + 0.1 * np.arange(int(np.prod(ranks))).reshape(ranks) / max(1, int(np.prod(ranks)))
    square, history = cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0, []

    def projected(skip: str) -> DataFrame:
        """(id of ``skip``, vec) of the tensor times the other two factors, flattened."""
        a, b = [x for x in "ijk" if x != skip]
        j = cells.join(factors[a].select(F.col("id").alias(a), F.col("vec").alias("__a")), a).join(factors[b].select(F.col("id").alias(b), F.col("vec").alias("__b")), b)
        names = [(p, q) for p in range(size[a]) for q in range(size[b])]
        sums = j.groupBy(F.col(skip).alias("id")).agg(*[F.sum(F.col("value") * F.get("__a", F.lit(p)) * F.get("__b", F.lit(q))).alias(f"v{p}_{q}") for p, q in names])
        return sums.select("id", F.array(*[F.col(f"v{p}_{q}") for p, q in names]).alias("vec"))

    def unfolded(t: np.ndarray, mode: str) -> np.ndarray:
        return np.moveaxis(t, "ijk".index(mode), 0).reshape(size[mode], -1)

    for _ in range(rounds):
        for mode in "ijk":
            a, b = [x for x in "ijk" if x != mode]
            g = np.kron(gram(factors[a], size[a]), gram(factors[b], size[b]))
            flat = unfolded(core, mode)
            top, below = rotate(projected(mode), flat.T), rotate(factors[mode], flat @ g @ flat.T)
            zero = F.array(*[F.lit(0.0)] * size[mode])
            factors[mode] = cut(_elementwise(factors[mode], lambda v, p, q, zero=zero: F.transform(F.arrays_zip(F.col(v).alias("a"), F.coalesce(F.col(p), zero).alias("b"), F.col(q).alias("c")), lambda s: s["a"] * s["b"] / (s["c"] + pad)), top, below))
        grams = [gram(factors[x], size[x]) for x in "ijk"]
        joined = factors["i"].join(projected("i").select("id", F.col("vec").alias("__p")), "id")
        m = size["j"] * size["k"]
        r = joined.agg(*[F.sum(F.get("vec", F.lit(p)) * F.get("__p", F.lit(q))).alias(f"c{p}_{q}") for p in range(size["i"]) for q in range(m)]).first()
        inner = np.array([[r[f"c{p}_{q}"] or 0.0 for q in range(m)] for p in range(size["i"])]).reshape(ranks)
        whole = np.einsum("abc,ax,by,cz->xyz", core, *grams)
        core = core * inner / (whole + pad)
        whole = np.einsum("abc,ax,by,cz->xyz", core, *grams)
        history.append(float(square - 2 * (core * inner).sum() + (core * whole).sum()))
    return factors, core, history


def nuclear_completion(m: CoordMatrix, k: int, tau: float, rounds: int = 5) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Rank-k completion of the cells present with a penalty on the sum of singular values: gradient steps on those cells, then soft thresholds."""
    m = CoordMatrix(cut(m.cells), m.n_rows, m.n_cols)
    u, s, v = soft_threshold(m, k, tau)
    for _ in range(rounds):
        fit = factor_scores(m.cells, u, v, s).withColumnRenamed("value", "__f")
        gap = CoordMatrix(cut(m.cells.join(fit, ["row", "col"]).select("row", "col", (F.col("value") - F.col("__f")).alias("value"))), m.n_rows, m.n_cols)
        # the sum of a low-rank part and a sparse part times factors needs only products with each
        t, w = gap.transpose(), orthonormal(v, k)
        for _ in range(2):
            left = _both(times_factors(gap, w, k), rotate(u, np.diag(s) @ gram(v, k, w)), k)
            w = orthonormal(_both(times_factors(t, left, k), rotate(v, np.diag(s) @ gram(u, k, left)), k), k)
        left = cut(_both(times_factors(gap, w, k), rotate(u, np.diag(s) @ gram(v, k, w)), k))
        e, x = np.linalg.eigh(gram(left, k))
        order = np.argsort(-e)
        size = np.sqrt(np.maximum(e[order], 0))
        scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0.0)
        u, s, v = cut(rotate(left, x[:, order] * scale)), np.maximum(size - tau, 0), cut(rotate(w, x[:, order]))
    return u, s, v


def _both(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    j = a.select("id", F.col("vec").alias("__x")).join(b.select("id", F.col("vec").alias("__y")), "id", "full_outer")
    zero = F.array(*[F.lit(0.0)] * k)
    return cut(j.select("id", F.zip_with(F.coalesce("__x", zero), F.coalesce("__y", zero), lambda x, y: x + y).alias("vec")))


def _towards(step: float):
    """The point a share of the way from a to b."""
    return lambda a, b: a + (b - a) * step


def linked_factors(user_group: CoordMatrix, user_user: CoordMatrix, k: int, weight: float = 1.0, reg: float = 0.1, rounds: int = 5) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray, list[float]]:
    """Users U, groups G, L1, L2 and the objective by round of :func:`linked_objective`.

    Each part in turn takes its regularised least-squares solution with the others fixed. U also stands on the right of
    U L2 U', so its step is shortened until the objective does not rise."""
    ug, uu = CoordMatrix(cut(user_group.cells), user_group.n_rows, user_group.n_cols), CoordMatrix(cut(user_user.cells), user_user.n_rows, user_user.n_cols)
    u, g = cut(start_factors(ug, k, "row")), cut(start_factors(ug, k, "col"))
    l1, l2, eye, t = np.eye(k), np.eye(k), np.eye(k), ug.transpose()
    zero = F.array(*[F.lit(0.0)] * k)

    def mixed(a: np.ndarray, b: np.ndarray, target: np.ndarray, penalty: float) -> np.ndarray:
        """L with A L B + penalty L = target."""
        return np.linalg.solve(np.kron(a, b.T) + penalty * np.eye(k * k), target.ravel()).reshape(k, k)

    history = [linked_objective(ug, uu, u, g, l1, l2, weight, reg)]
    for _ in range(rounds):
        uu_gram = gram(u, k)
        solved = rotate(times_factors(t, rotate(u, l1), k), np.linalg.inv(l1.T @ uu_gram @ l1 + reg * eye))
        g = cut(g.select("id").join(solved, "id", "left").select("id", F.coalesce("vec", zero).alias("vec")))
        g_gram = gram(g, k)
        l1 = mixed(uu_gram, g_gram, gram(u, k, times_factors(ug, g, k)), reg)
        l2 = mixed(uu_gram, uu_gram, gram(u, k, times_factors(uu, u, k)), reg / weight if weight else 1.0)
        now = linked_objective(ug, uu, u, g, l1, l2, weight, reg)
        left = times_factors(ug, rotate(g, l1.T), k).unionByName(times_factors(uu, rotate(u, weight * l2.T), k))
        top = left.groupBy("id").agg(*[F.sum(F.get("vec", F.lit(c))).alias(f"v{c}") for c in range(k)]).select("id", F.array(*[F.col(f"v{c}") for c in range(k)]).alias("vec"))
        best = rotate(top, np.linalg.inv(l1 @ g_gram @ l1.T + weight * l2 @ uu_gram @ l2.T + reg * eye)).select("id", F.col("vec").alias("__b"))
        goal = cut(u.join(best, "id", "left").select("id", "vec", F.coalesce("__b", zero).alias("__b")))
        step = 1.0
        while step > 1e-3:
            moved = goal.select("id", F.zip_with("vec", "__b", _towards(step)).alias("vec"))
            value = linked_objective(ug, uu, moved, g, l1, l2, weight, reg)
            if value <= now:
                u, now = cut(moved), value
                break
            step /= 2
        history.append(now)
    return u, g, l1, l2, history
