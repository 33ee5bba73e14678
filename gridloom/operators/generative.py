"""Generative classification by trees, compared with logistic regression, and recovery trials as one grouped job.

A class is described by variables whose dependences form a tree, so its distribution is normalised exactly:
P(x) = P(x_root) * product of P(x_i | x_parent). All classes' counts come from one pass over distinct observations; trees and tables
are as large as the model and stay on the driver. Bayes' rule turns them into log-odds, an expression inside the row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fields import _indicators


@dataclass
class Tree:
    """``parents``: of each variable, -1 for roots. ``tables``: of a root the log probabilities of its states, of others a row for each state of the parent."""

    parents: list[int]
    tables: list[np.ndarray]

    def log_probability(self, x: str = "x") -> Column:
        out = F.lit(0.0)
        for i, (p, t) in enumerate(zip(self.parents, self.tables, strict=True)):
            place = F.col(x)[i] + 1 if p < 0 else F.col(x)[p] * t.shape[1] + F.col(x)[i] + 1
            out = out + F.element_at(F.array(*[F.lit(float(v)) for v in t.ravel()]), place.cast("int"))
        return out


@dataclass
class Classifier:
    """Labels, their log shares and a tree of each."""

    labels: list[int]
    shares: list[float]
    trees: list[Tree]

    def log_odds(self, x: str = "x") -> Column:
        """Of two classes: the logarithm of the second one's probability over the first one's."""
        a, b = ((s + t.log_probability(x)) for s, t in zip(self.shares, self.trees, strict=True))
        return b - a

    def predicted(self, x: str = "x") -> Column:
        """The most probable label, the first of equal ones."""
        scores = F.array(*[F.lit(s) + t.log_probability(x) for s, t in zip(self.shares, self.trees, strict=True)])
        return F.element_at(F.array(*map(F.lit, self.labels)), F.array_position(scores, F.array_max(scores)).cast("int"))


def class_counts(observations: DataFrame, label: str = "y") -> DataFrame:
    """(y, a, b, s, t, n) of each class, a <= b: how often a is in state s while b is in state t; for a = b single counts."""
    rows = observations.groupBy(F.col(label).alias("y"), "x").agg(F.count("*").alias("n"))
    pairs = rows.select("y", "n", "x", F.posexplode("x").alias("a", "s")).select("y", "n", "a", "s", F.posexplode("x").alias("b", "t")).filter("a <= b")
    return pairs.groupBy("y", "a", "b", "s", "t").agg(F.sum("n").alias("n"))


def _information(joint: np.ndarray) -> float:
    p = joint / max(joint.sum(), 1e-300)
    x, y, on = p.sum(axis=1), p.sum(axis=0), p > 0
    return float((p[on] * np.log(p[on] / np.outer(x, y)[on])).sum())


def best_tree(weights: np.ndarray) -> list[int]:
    """Parents in the spanning tree of largest weight, root 0; equal weights by smaller variables first."""
    n = len(weights)
    parents, inside = [-1] * n, {0} if n else set()
    while len(inside) < n:
        _, _, i, j = max((round(float(weights[i, j]), 12), -min(i, j) * n - max(i, j), i, j) for i in inside for j in range(n) if j not in inside)
        parents[j] = i
        inside.add(j)
    return parents


def fit_trees(observations: DataFrame, nodes: int, states: int, label: str = "y", parents: list[int] | None = None, pad: float = 1.0) -> Classifier:
    """A tree for each class, its own best one unless ``parents`` are given; ``pad`` is added to every count of a table."""
    joint: dict[int, np.ndarray] = {}
    for r in class_counts(observations, label).collect():  # classes times pairs of variables times pairs of states
        j = joint.setdefault(r["y"], np.zeros((nodes, nodes, states, states)))
        j[r["a"], r["b"], r["s"], r["t"]] = r["n"]
        j[r["b"], r["a"], r["t"], r["s"]] = r["n"]
    labels, total = sorted(joint), sum(j[0, 0].sum() for j in joint.values()) if nodes else 0
    trees = []
    for y in labels:
        j = joint[y]
        own = parents if parents is not None else best_tree(np.array([[_information(j[a, b]) if a != b else 0.0 for b in range(nodes)] for a in range(nodes)]))
        tables = []
        for i, p in enumerate(own):
            counts = (np.diag(j[i, i]) if p < 0 else j[p, i]) + pad
            tables.append(np.log(counts / counts.sum(axis=-1, keepdims=True)))
        trees.append(Tree(list(own), tables))
    return Classifier(labels, [float(np.log(joint[y][0, 0].sum() / total)) for y in labels], trees)


def misclassified(observations: DataFrame, predicted: Column, label: str = "y") -> float:
    return observations.agg(F.avg((predicted != F.col(label)).cast("double"))).first()[0] or 0.0


def _newton(counts: np.ndarray, x: np.ndarray, states: int, rounds: int = 50, ridge: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression of labels 0 and 1 on indicators. ``counts``: of distinct x by label."""
    z, n = _indicators(x, states), counts.sum(axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (n * p - counts[:, 1]) + ridge * n.sum() * w
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge * max(n.sum(), 1) * np.eye(len(w)), g)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _in_trials(observations: DataFrame, trials: int, sizes: Sequence[int], key: str) -> DataFrame:
    """Each observation once for every (trial, size) it is drawn into: its draw in the trial lies below size / rows, so smaller samples are parts of larger ones."""
    total = max(observations.count(), 1)
    limits = sorted(sizes)
    drawn = observations.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    u = F.conv(F.substring(F.md5(F.concat_ws(",", F.col("trial").cast("string"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    inside = F.filter(F.array(*map(F.lit, limits)), lambda n: F.col("__u") < n / F.lit(float(total)))
    return drawn.withColumn("__u", u).withColumn("size", F.explode(inside)).drop("__u")


def learning_curves(observations: DataFrame, test: DataFrame, nodes: int, states: int, sizes: Sequence[int], trials: int = 3, key: str = "key") -> DataFrame:
    """(size, generative, discriminative): mean error on ``test`` of trees and of logistic regression learned from samples of each size.

    All (trial, size) are groups of one job; a group gets the distinct observations of a sample of bounded size. ``y`` is 0 or 1."""
    groups = _in_trials(observations.select(key, "x", "y"), trials, sizes, key).groupBy("trial", "size", "x").agg(*[F.sum((F.col("y") == v).cast("long")).alias(f"n{v}") for v in (0, 1)])
    held = test.groupBy("x").agg(*[F.sum((F.col("y") == v).cast("long")).alias(f"n{v}") for v in (0, 1)])
    asked = held.collect()  # distinct states of a few variables
    tx, tn = np.array([r["x"] for r in asked]).reshape(len(asked), nodes), np.array([[r["n0"], r["n1"]] for r in asked]).reshape(len(asked), 2)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = np.stack(pdf["x"].to_numpy()), pdf[["n0", "n1"]].to_numpy(float)
        scores = []
        for y in (0, 1):
            j = np.einsum("ras,rbt,r->abst", x[:, :, None] == np.arange(states), x[:, :, None] == np.arange(states), n[:, y])
            own = best_tree(np.array([[_information(j[a, b]) if a != b else 0.0 for b in range(nodes)] for a in range(nodes)]))
            s = np.full(len(tx), np.log((n[:, y].sum() + 1) / (n.sum() + 2)))
            for i, p in enumerate(own):
                c = (np.diag(j[i, i]) if p < 0 else j[p, i]) + 1.0
                t = np.log(c / c.sum(axis=-1, keepdims=True))
                s = s + (t[tx[:, i]] if p < 0 else t[tx[:, p], tx[:, i]])
            scores.append(s)
        by_trees = scores[1] > scores[0]
        by_weights = _indicators(tx, states) @ _newton(n, x, states) > 0
        error = lambda said: float(tn[np.arange(len(tx)), 1 - said.astype(int)].sum() / max(tn.sum(), 1))
        return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "size": [pdf["size"].iloc[0]], "generative": [error(by_trees)], "discriminative": [error(by_weights)]})

    out = groups.groupBy("trial", "size").applyInPandas(one, "trial int, size int, generative double, discriminative double")
    return out.groupBy("size").agg(F.avg("generative").alias("generative"), F.avg("discriminative").alias("discriminative"))


# Recovery trials


def local_path(x: np.ndarray, n: np.ndarray, states: int, penalties: Sequence[float], rounds: int) -> Iterator[tuple[float, np.ndarray]]:
    """The block norms of :func:`fields.neighbourhood_path` for one bounded sample, distinct rows ``x`` with counts ``n``."""
    nodes, s = x.shape[1], states - 1
    z, d, total = _indicators(x, states), x.shape[1] * (states - 1), max(n.sum(), 1)
    free = np.ones((1 + d, d), bool)
    for i in range(nodes):
        free[1 + i * s : 1 + (i + 1) * s, i * s : (i + 1) * s] = False
    y = z[:, 1:].reshape(len(x), nodes, s)
    step = 2.0 / max(float(np.linalg.eigvalsh(z.T @ (z * n[:, None]) / total).max()), 1e-12)
    w = np.zeros((1 + d, d))
    for penalty in sorted(penalties, reverse=True):
        ahead, t = w.copy(), 1.0
        for _ in range(rounds):
            scores = (z @ ahead).reshape(len(x), nodes, s)
            top = np.maximum(scores.max(axis=2, initial=0.0), 0.0)[:, :, None]
            e = np.exp(scores - top)
            p = e / (e.sum(axis=2, keepdims=True) + np.exp(-top))
            new = np.where(free, ahead - step * (z.T @ ((p - y) * n[:, None, None]).reshape(len(x), -1)) / total, 0.0)
            norms = np.sqrt((new[1:].reshape(nodes, s, nodes, s) ** 2).sum(axis=(1, 3)))
            new[1:] *= np.repeat(np.repeat(np.maximum(0.0, 1 - step * penalty / np.maximum(norms, 1e-300)), s, axis=0), s, axis=1)
            if ((ahead - new) * (new - w)).sum() > 0:
                t = 1.0
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, change, t, w = new + (t - 1) / t_new * (new - w), np.abs(new - w).max(), t_new, new
            if change < 1e-7:
                break
        yield penalty, np.sqrt((w[1:].reshape(nodes, s, nodes, s) ** 2).sum(axis=(1, 3)))


def trial_edges(observations: DataFrame, nodes: int, states: int, sizes: Sequence[int], penalties: Sequence[float], trials: int, cutoff: float = 0.05, rounds: int = 200, key: str = "key", store: str | None = None) -> DataFrame:
    """(trial, size, penalty, a, b) of the edges found, either way, in each sample: one job over (trial, size) groups, the penalties as a path within.

    With ``store``, a folder, results are kept there by trial; trials found there are not run again, so a broken run goes on where it stopped."""
    spark = observations.sparkSession
    wanted = list(range(trials))
    if store is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        kept = {r["trial"] for r in spark.read.parquet(store).select("trial").distinct().collect()} if there else set()
        wanted = [t for t in wanted if t not in kept]
    drawn = _in_trials(observations.select(key, "x"), trials, sizes, key).filter(F.col("trial").isin(wanted) if wanted else F.lit(False))
    groups = drawn.groupBy("trial", "size", "x").agg(F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, rows = np.stack(pdf["x"].to_numpy()), pdf["n"].to_numpy(float), []
        for penalty, norms in local_path(x, n, states, penalties, rounds):
            on = (norms > cutoff) | (norms.T > cutoff)
            found = [(a, b) for a in range(nodes) for b in range(a + 1, nodes) if on[a, b]]
            rows += [(pdf["trial"].iloc[0], pdf["size"].iloc[0], penalty, a, b) for a, b in found or [(-1, -1)]]  # no edge at all is a result too
        return pd.DataFrame(rows, columns=["trial", "size", "penalty", "a", "b"])

    found = groups.groupBy("trial", "size").applyInPandas(one, "trial int, size int, penalty double, a int, b int")
    if store is None:
        return found
    if wanted:
        found.repartition("trial").write.mode("append").parquet(store)
    return spark.read.schema(found.schema).parquet(store).filter(F.col("trial") < trials)


def success_curve(edges: DataFrame, truth: set[tuple[int, int]]) -> DataFrame:
    """(size, penalty, success, differing): the share of trials whose edges are just ``truth``, and how many edges differ on average."""
    right = F.concat_ws("-", "a", "b").isin([f"{a}-{b}" for a, b in truth] or [""])
    each = edges.groupBy("trial", "size", "penalty").agg(F.sum(right.cast("int")).alias("hits"), F.sum((F.col("a") >= 0).cast("int")).alias("found"))
    differing = F.col("found") + len(truth) - 2 * F.col("hits")
    return each.groupBy("size", "penalty").agg(F.avg((differing == 0).cast("double")).alias("success"), F.avg(differing).alias("differing"))


__all__ = ["Classifier", "Tree", "best_tree", "class_counts", "fit_trees", "learning_curves", "local_path", "misclassified", "success_curve", "trial_edges"]
