"""Logistic regression with L1 and group penalties, neighbourhood selection, and samplers of discrete models.

Gradients are sums over the samples, so they come from one aggregation of the DataFrame; parameters are
small and stay on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lambda_from_c
from .optimise import Options


def margin(features: list[str], beta: np.ndarray) -> Column:
    """b0 + sum b_i x_i."""
    m = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], features, strict=True):
        m = m + float(b) * F.col(x)
    return m


def log1p_exp(m: Column) -> Column:
    return F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))


def logistic_loss(df: DataFrame, features: list[str], label: str, beta: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of 0/1 labels and its gradient, in one aggregation."""
    m = margin(features, beta)
    p = 1 / (1 + F.exp(-m)) - F.col(label)
    r = df.agg(F.avg(log1p_exp(m) - F.col(label) * m).alias("f"), F.avg(p).alias("g0"), *[F.avg(p * F.col(x)).alias(f"g{i}") for i, x in enumerate(features, 1)]).first()
    return r["f"], np.array([r[f"g{i}"] for i in range(len(features) + 1)])


def logistic_l1(df: DataFrame, features: list[str], label: str, penalty: float, rounds: int = 60) -> np.ndarray:
    """Intercept (not penalised) and weights: proximal gradient steps with momentum."""
    bound = df.agg(F.avg(sum((F.col(x) * F.col(x) for x in features), F.lit(1.0)))).first()[0] or 1.0
    step, beta, ahead, t = 4.0 / bound, np.zeros(len(features) + 1), np.zeros(len(features) + 1), 1.0
    for _ in range(rounds):
        _, g = logistic_loss(df, features, label, ahead)
        new = ahead - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - beta)
        if np.abs(new - beta).max() < 1e-7:
            return new
        beta, t = new, t_new
    return beta


def logistic_l1_validated(df: DataFrame, features: list[str], label: str, constants: list[float], fold: str, rounds: int = 40) -> tuple[np.ndarray, float]:
    """The constant c of least mean held-out loss over the folds in column ``fold``; penalty c * sqrt(ln p / n)."""
    k, n = df.agg(F.max(fold)).first()[0], df.count()
    loss = {}
    for c in constants:
        lam = lambda_from_c(c, max(2, len(features)), n)
        parts = [logistic_loss(df.filter(F.col(fold) == i), features, label, logistic_l1(df.filter(F.col(fold) != i), features, label, lam, rounds))[0] for i in range(1, k + 1)]
        loss[c] = float(np.mean(parts))
    best = min(constants, key=lambda c: (loss[c], c))
    return logistic_l1(df, features, label, lambda_from_c(best, max(2, len(features)), n), rounds), best


def classify(features: list[str], beta: np.ndarray, bias: bool = True) -> Column:
    """1 where the margin is at least 0, else -1."""
    b = beta if bias else np.append(0.0, beta[1:])
    return F.when(margin(features, b) >= 0, 1).otherwise(-1)


def multinomial_loss(df: DataFrame, features: list[str], label: str, b: np.ndarray) -> tuple[float, np.ndarray]:
    """``b``: classes - 1 by (1 + features); the last class is the reference. Mean negative log likelihood and gradient."""
    k = b.shape[0]
    m = [margin(features, row) for row in b]
    top = F.greatest(*m, F.lit(0.0)) if k > 1 else F.greatest(m[0], F.lit(0.0))
    log_sum = top + F.log(sum((F.exp(x - top) for x in m), F.exp(-top)))
    own = F.lit(0.0)
    for c, x in enumerate(m):
        own = F.when(F.col(label) == c, x).otherwise(own)
    cols = [F.lit(1.0), *[F.col(x) for x in features]]
    grad = [F.avg((F.exp(x - log_sum) - F.when(F.col(label) == c, 1.0).otherwise(0.0)) * v).alias(f"g{c}_{i}") for c, x in enumerate(m) for i, v in enumerate(cols)]
    r = df.agg(F.avg(log_sum - own).alias("f"), *grad).first()
    return r["f"], np.array([[r[f"g{c}_{i}"] for i in range(len(cols))] for c in range(k)])


def group_penalty(b: np.ndarray, groups: list[list[int]]) -> float:
    """Sum of Frobenius norms of the groups' columns."""
    return float(sum(np.linalg.norm(b[:, g]) for g in groups))


def group_lasso(df: DataFrame, features: list[str], label: str, classes: int, groups: list[list[int]], penalty: float, rounds: int = 60) -> np.ndarray:
    """Multinomial regression with a penalty on whole groups of features (indices into ``features``)."""
    bound = df.agg(F.avg(sum((F.col(x) * F.col(x) for x in features), F.lit(1.0)))).first()[0] or 1.0
    step, b, ahead, t = 2.0 / bound, np.zeros((classes - 1, len(features) + 1)), np.zeros((classes - 1, len(features) + 1)), 1.0
    for _ in range(rounds):
        _, g = multinomial_loss(df, features, label, ahead)
        new = ahead - step * g
        for group in groups:
            cols = [1 + i for i in group]
            size = np.linalg.norm(new[:, cols])
            new[:, cols] *= max(0.0, 1 - step * penalty / size) if size else 0.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - b)
        if np.abs(new - b).max() < 1e-7:
            return new
        b, t = new, t_new
    return b


def observed(samples: DataFrame) -> DataFrame:
    """(sample, node, state) as one row a sample: sample and ``x``, the states by node. Each sample has each node once."""
    nodes = samples.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("node", "state"))).alias("__x"))  # one entry a node
    return nodes.select("sample", F.transform("__x", lambda v: v["state"]).alias("x"))


def wide(observations: DataFrame, nodes: int) -> DataFrame:
    """One row an observation with columns n0, n1, ...; ``observations``: a row each, ``x`` the states by node. Equal rows stay."""
    return observations.select(*[F.col("x")[i].cast("double").alias(f"n{i}") for i in range(nodes)])


def ising(observations: DataFrame, nodes: int, penalty: float, rounds: int = 40) -> np.ndarray:
    """Couplings of a binary model (states 0 and 1 read as -1 and 1): one L1 regression a node, halves averaged over both directions."""
    w = wide(observations, nodes).select(*[(2 * F.col(f"n{i}") - 1).alias(f"x{i}") for i in range(nodes)], *[F.col(f"n{i}").alias(f"y{i}") for i in range(nodes)]).cache()
    j = np.zeros((nodes, nodes))
    for i in range(nodes):
        others = [k for k in range(nodes) if k != i]
        j[i, others] = logistic_l1(w, [f"x{k}" for k in others], f"y{i}", penalty, rounds)[1:] / 2
    w.unpersist()
    return (j + j.T) / 2


def neighbours(couplings: np.ndarray, cutoff: float, either: bool = True) -> np.ndarray:
    on = np.abs(couplings) > cutoff
    np.fill_diagonal(on, False)
    return on | on.T if either else on & on.T


def incoherence(hessian: np.ndarray, inside: list[int]) -> tuple[float, float]:
    """Largest row sum of |Q_out,in Q_in,in^-1| and the least eigenvalue of Q_in,in."""
    outside = [i for i in range(len(hessian)) if i not in inside]
    q = hessian[np.ix_(inside, inside)]
    cross = np.abs(hessian[np.ix_(outside, inside)] @ np.linalg.inv(q)).sum(axis=1).max(initial=0.0)
    return float(cross), float(np.linalg.eigvalsh(q).min())


def _chains(couplings: np.ndarray, fields: np.ndarray, burn_in: int, gap: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, nodes, states = [], [], []
            for chain, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng([seed, chain])
                x = rng.choice([-1, 1], len(fields))
                for sweep in range(burn_in + gap * n):
                    for i in range(len(x)):
                        p = 1 / (1 + np.exp(-2 * (couplings[i] @ x + fields[i])))
                        x[i] = 1 if rng.random() < p else -1
                    if sweep >= burn_in and (sweep - burn_in) % gap == gap - 1:
                        samples += [chain * 1_000_000 + (sweep - burn_in) // gap] * len(x)
                        nodes += range(len(x))
                        states += ((x + 1) // 2).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(samples, pa.int64()), pa.array(nodes, pa.int32()), pa.array(states, pa.int32())], names=["sample", "node", "state"])

    return run


def gibbs(spark: SparkSession, couplings: np.ndarray, fields: np.ndarray, n: int, chains: int = 8, burn_in: int = 200, gap: int = 5, seed: int = 1) -> DataFrame:
    """(sample, node, state) of a binary model; chains run in parallel, each from its own seeded stream."""
    np.fill_diagonal(couplings := np.array(couplings, float), 0.0)
    each = -(-n // chains)
    starts = spark.range(chains, numPartitions=chains).select("id", F.lit(each).alias("n"))
    return starts.mapInArrow(_chains(couplings, np.array(fields, float), burn_in, gap, seed), "sample long, node int, state int")


def tree_marginals(couplings: np.ndarray, fields: np.ndarray) -> np.ndarray:
    """P(x_i = 1) of a binary model whose couplings form a forest: exact after as many rounds of messages as there are nodes."""
    return belief_propagation(couplings, fields, rounds=len(fields), tolerance=0.0)[0]


def belief_propagation(couplings: np.ndarray, fields: np.ndarray, rounds: int = 200, tolerance: float = 1e-9, damping: float = 0.0) -> tuple[np.ndarray, int]:
    """P(x_i = 1) of a binary model by passing messages along all couplings, and the rounds it took; on graphs with cycles an estimate.

    All messages of a round are made from those of the round before, of which ``damping`` is kept; it ends when none changes by more than ``tolerance``."""
    n, signs = len(fields), np.array([-1, 1])
    phi = np.exp(np.outer(fields, signs))
    links = [[j for j in range(n) if j != i and couplings[i, j]] for i in range(n)]
    messages = {(i, j): np.full(2, 0.5) for i in range(n) for j in links[i]}
    k = 0
    for k in range(1, rounds + 1):
        new = {}
        for i, j in messages:
            own = phi[i] * np.prod([messages[x, i] for x in links[i] if x != j], axis=0)
            m = np.exp(couplings[i, j] * np.outer(signs, signs)).T @ own
            new[i, j] = damping * messages[i, j] + (1 - damping) * m / m.sum()
        change = max((np.abs(new[e] - messages[e]).max() for e in messages), default=0.0)
        messages = new
        if change <= tolerance:
            break
    out = np.array([phi[i] * np.prod([messages[x, i] for x in links[i]], axis=0) for i in range(n)]).reshape(n, 2)
    return out[:, 1] / out.sum(axis=1), k


def negated(couplings: np.ndarray, fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model that prefers what the given one avoids."""
    return -np.asarray(couplings), -np.asarray(fields)


def pairwise_couplings(adjacency: np.ndarray, least: float, spread: float, kind: str = "normal", seed: int = 1) -> np.ndarray:
    """A coupling for each edge of the upper half: ``least`` plus ``spread`` times a seeded draw, normal or uniform on [0, 1)."""
    rng, out = np.random.default_rng(seed), np.zeros(adjacency.shape)
    i, j = np.nonzero(np.triu(adjacency, 1))
    out[i, j] = least + spread * (rng.standard_normal(len(i)) if kind == "normal" else rng.random(len(i)))
    return out + out.T


def pseudo_likelihood(observations: DataFrame, couplings: np.ndarray, fields: np.ndarray) -> DataFrame:
    """One row: the mean over the observations of minus the log of each node's probability given all others, summed over the nodes (states 0 and 1 read as -1 and 1)."""
    n = len(fields)
    w = wide(observations, n)
    x = [2 * F.col(f"n{i}") - 1 for i in range(n)]
    total = F.lit(0.0)
    for i in range(n):
        m = sum((float(couplings[i, j]) * x[j] for j in range(n) if j != i and couplings[i, j]), F.lit(float(fields[i])))
        total = total + log1p_exp(-2 * x[i] * m)
    return w.agg(F.avg(total).alias("loss"))


def ising_validated(observations: DataFrame, nodes: int, constants: list[float], folds: int = 3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Couplings under the constant c of least mean held-out pseudo-likelihood loss, penalty c * sqrt(ln p / n); observations are dealt to folds by a hash of ``sample``, which names each."""
    fold = F.pmod(F.xxhash64("sample"), F.lit(folds))
    n, loss = observations.count(), {}
    for c in constants:
        parts = []
        for k in range(folds):
            j = ising(observations.filter(fold != k), nodes, lambda_from_c(c, max(2, nodes - 1), n), rounds)
            parts.append(pseudo_likelihood(observations.filter(fold == k), j, np.zeros(nodes)).first()["loss"])
        loss[c] = float(np.mean([x for x in parts if x is not None] or [np.inf]))
    best = min(constants, key=lambda c: (loss[c], c))
    return ising(observations, nodes, lambda_from_c(best, max(2, nodes - 1), n), rounds), best


__all__ = ["Options", "belief_propagation", "classify", "gibbs", "group_lasso", "group_penalty", "incoherence", "ising", "ising_validated", "logistic_l1", "logistic_l1_validated", "logistic_loss", "multinomial_loss", "negated", "neighbours", "observed", "pairwise_couplings", "pseudo_likelihood", "tree_marginals", "wide"]
