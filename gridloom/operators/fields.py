"""Random fields of variables with k states and pairwise couplings.

Two forms, by what is large:

* ``Field``: few variables, any number of observations. The model is held by the driver and stands in the plan as literals; an observation is a row
  with an array ``x`` of states. Conditionals and pseudo-likelihood work inside the row, Gibbs sweeps inside a batch of rows, without an exchange.
* ``FieldTables``: any number of variables. Model and states are tables; a variable's conditional is a join with its neighbours' states and a grouped
  sum. Gibbs goes by colour classes (``colouring``): variables of one colour are not linked and are drawn together.

All neighbourhoods are learned at once (``neighbourhood_path``): with the states as indicators X, the gradients of all variables' multinomial
regressions are one matrix X' (P - Y), summed over distinct observations in one pass a step, for all penalties of a path with warm starts.

Draws come from the MD5 of (seed, sweep, key, variable), so they do not depend on where a row lies and repeat after a lost task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass
class Field:
    """``own``: variables by states. ``blocks``: for a < b the couplings of a's states (rows) with b's."""

    own: np.ndarray
    blocks: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @property
    def nodes(self) -> int:
        return self.own.shape[0]

    @property
    def states(self) -> int:
        return self.own.shape[1]

    def block(self, i: int, j: int) -> np.ndarray | None:
        """The couplings seen from i."""
        b = self.blocks.get((i, j)) if i < j else self.blocks.get((j, i))
        return b if b is None or i < j else b.T

    def neighbours(self, i: int) -> list[int]:
        return sorted({j for e in self.blocks for j in e if i in e} - {i})

    def classes(self) -> list[list[int]]:
        """Variables by colour: each the smallest that no smaller neighbour has."""
        colour: list[int] = []
        for i in range(self.nodes):
            taken = {colour[j] for j in self.neighbours(i) if j < i}
            colour.append(next(c for c in range(self.nodes) if c not in taken))
        return [[i for i in range(self.nodes) if colour[i] == c] for c in range(max(colour, default=-1) + 1)]

    def negated(self) -> Field:
        """The field that prefers what this one avoids."""
        return Field(-self.own, {e: -b for e, b in self.blocks.items()})


def generated(adjacency: np.ndarray, states: int, least: float, spread: float, kind: str = "normal", seed: int = 1) -> Field:
    """A field on a graph: for each edge couplings of the first k - 1 states, ``least`` plus ``spread`` times a seeded draw, normal or uniform on [0, 1); the last state has none."""
    rng, blocks = np.random.default_rng(seed), {}
    for i, j in zip(*np.nonzero(np.triu(adjacency, 1)), strict=True):
        shape = (states - 1, states - 1)
        blocks[int(i), int(j)] = np.pad(least + spread * (rng.standard_normal(shape) if kind == "normal" else rng.random(shape)), ((0, 1), (0, 1)))
    return Field(np.zeros((len(adjacency), states)), blocks)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _scores(f: Field, i: int, x: str = "x") -> Column:
    """The logarithms, up to a number, of the probabilities of i's states given the others'."""
    out = _numbers(f.own[i])
    for j in f.neighbours(i):
        b = f.block(i, j)
        seen = F.element_at(F.array(*[_numbers(b[:, t]) for t in range(f.states)]), F.col(x)[j] + 1)
        out = F.zip_with(out, seen, lambda a, c: a + c)
    return out


def _shares(scores: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def conditionals(observations: DataFrame, f: Field) -> DataFrame:
    """(x, n, p): each distinct observation, how often it occurs, and for every variable the probabilities of its states given the others."""
    rows = observations.groupBy("x").agg(F.count("*").alias("n"))
    return rows.select("x", "n", F.array(*[_shares(_scores(f, i)) for i in range(f.nodes)]).alias("p"))


def pseudo_likelihood(observations: DataFrame, f: Field) -> DataFrame:
    """One row: the mean over observations of minus the logarithm of each variable's probability given all others, summed over the variables."""
    own = conditionals(observations, f)
    loss = sum((-F.log(F.element_at(F.col("p")[i], F.col("x")[i] + 1)) for i in range(f.nodes)), F.lit(0.0))
    return own.agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("loss"))


def draw(seed: int, sweep: int, key: Column, node: int | Column) -> Column:
    """A number in [0, 1) that any engine with MD5 can repeat."""
    node = F.lit(node) if isinstance(node, int) else node
    text = F.concat_ws(",", F.lit(str(seed)), F.lit(str(sweep)), key.cast("string"), node.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _picked(shares: Column, u: Column) -> Column:
    """The first state whose cumulated probability exceeds ``u``, else the last."""
    sums = F.transform(shares, lambda v, s: F.aggregate(F.slice(shares, F.lit(1), s + 1), F.lit(0.0), lambda a, b: a + b))
    return F.least(F.size(F.filter(sums, lambda c: c <= u)), F.size(shares) - 1).cast("int")


def _numbers_drawn(seed: int, sweep: int, keys: list, node: int) -> np.ndarray:
    """``draw`` for the keys of a batch."""
    return np.array([int(hashlib.md5(f"{seed},{sweep},{k},{node}".encode()).hexdigest()[:13], 16) for k in keys], float) / (1 << 52)


def gibbs(starts: DataFrame, f: Field, sweeps: int, key: str = "key", seed: int = 1) -> DataFrame:
    """The rows of ``starts`` (key, x and others) with x after so many sweeps of Gibbs sampling, one chain a row; rows of one key get the same draws.

    A sweep takes the colour classes in turn, all rows of a batch at once; all sweeps are one pass over the rows."""
    classes, own, k = f.classes(), f.own, f.states
    links = {i: [(j, f.block(i, j)) for j in f.neighbours(i)] for i in range(f.nodes)}
    at, named = starts.columns.index("x"), starts.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(named).to_pylist()
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, len(own)).astype(np.int32)
            for sweep in range(sweeps):
                for i in [i for members in classes for i in members]:
                    scores = own[i] + sum((b[:, x[:, j]].T for j, b in links[i]), np.zeros((len(x), k)))
                    e = np.exp(scores - scores.max(axis=1, keepdims=True))
                    u = _numbers_drawn(seed, sweep, keys, i)
                    x[:, i] = np.minimum((np.cumsum(e / e.sum(axis=1, keepdims=True), axis=1) <= u[:, None]).sum(axis=1), k - 1)
            new = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(own), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([new if c == at else batch.column(c) for c in range(batch.num_columns)], names=batch.schema.names)

    return starts.withColumn("x", F.col("x").cast("array<int>")).mapInArrow(run, starts.withColumn("x", F.col("x").cast("array<int>")).schema)


@dataclass(frozen=True)
class FieldTables:
    """``own``: node, own (array of k numbers). ``couplings``: a, b, block (array of k * k numbers, a's state times k plus b's), each edge once."""

    own: DataFrame
    couplings: DataFrame
    states: int

    def seen(self) -> DataFrame:
        """(node, to, block): each edge from both ends, a block as the node sees it."""
        k = self.states
        turned = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda p: F.element_at("block", (p % k * k + F.floor(p / k) + 1).cast("int")))
        there = self.couplings.select(F.col("a").alias("node"), F.col("b").alias("to"), "block")
        return there.unionByName(self.couplings.select(F.col("b").alias("node"), F.col("a").alias("to"), turned.alias("block")))


def table_conditionals(states: DataFrame, f: FieldTables, nodes: DataFrame | None = None) -> DataFrame:
    """(chain, node, p) from states (chain, node, state); ``nodes``: only of these."""
    k = f.states
    seen = f.seen() if nodes is None else f.seen().join(nodes.select("node"), "node", "left_semi")
    terms = seen.join(states.select("chain", F.col("node").alias("to"), "state"), "to").groupBy("chain", "node").agg(*[F.sum(F.element_at("block", F.col("state") + 1 + s * k)).alias(f"e{s}") for s in range(k)])
    every = states.select("chain", "node") if nodes is None else states.select("chain", "node").join(nodes.select("node"), "node", "left_semi")
    whole = every.join(f.own, "node").join(terms, ["chain", "node"], "left")
    scores = F.array(*[F.element_at("own", s + 1) + F.coalesce(f"e{s}", F.lit(0.0)) for s in range(k)])
    return whole.select("chain", "node", _shares(scores).alias("p"))


def colouring(edges: DataFrame, nodes: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, colour): linked nodes (a, b) get different colours. In a round every node whose neighbours of higher rank all have colours takes the smallest free one;
    ranks are hashes, so the rounds grow with the logarithm of the size."""
    rank = lambda c: F.struct(F.xxhash64(c), c)
    links = edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    before = cut(links.filter(rank("b") > rank("a")).select(F.col("a").alias("node"), F.col("b").alias("to")))  # who must be coloured first
    done, left = None, cut(nodes.select("node").distinct())
    for _ in range(rounds):
        if left.isEmpty():
            break
        if done is None:
            ready = left.join(before.select("node"), "node", "left_anti").select("node", F.lit(0).alias("colour"))
        else:
            known = before.join(left, "node", "left_semi").join(done.select(F.col("node").alias("to"), "colour"), "to", "left")
            taken = known.groupBy("node").agg(F.collect_set("colour").alias("taken"), F.max(F.col("colour").isNull()).alias("waits")).filter("NOT waits")  # at most a degree's entries
            free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
            ready = taken.select("node", free.cast("int").alias("colour"))
        ready = cut(ready)
        done = ready if done is None else cut(done.unionByName(ready))
        left = cut(left.join(ready, "node", "left_anti"))
    return done if done is not None else left.select("node", F.lit(0).alias("colour"))


def table_gibbs(states: DataFrame, f: FieldTables, colours: DataFrame, sweeps: int, seed: int = 1) -> DataFrame:
    """States (chain, node, state) after so many sweeps; in a round all nodes of one colour are drawn, in all chains."""
    colours = cut(colours)
    order = [r["colour"] for r in colours.select("colour").distinct().orderBy("colour").collect()]  # one row a colour
    for sweep in range(sweeps):
        for c in order:
            members = colours.filter(F.col("colour") == c)
            p = table_conditionals(states, f, members)
            new = p.select("chain", "node", _picked(F.col("p"), draw(seed, sweep, F.col("chain"), F.col("node"))).alias("state"))
            states = cut(states.join(members.select("node"), "node", "left_anti").select("chain", "node", "state").unionByName(new))
    return states


# Learning


def _indicators(x: np.ndarray, states: int) -> np.ndarray:
    """1, then for each variable the indicators of its states but the last."""
    on = x[:, :, None] == np.arange(states - 1)
    return np.concatenate([np.ones((len(x), 1)), on.reshape(len(x), -1)], axis=1)


def _sums(parameters: np.ndarray, nodes: int, states: int):
    """Rows (i, j, v) of a task: the gradient's matrix and, at (-1, variable), the losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, loss = np.zeros(parameters.shape), np.zeros(nodes)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, nodes)
            weight = b.column("n").to_numpy().astype(float)
            z = _indicators(x, states)
            scores = (z @ parameters).reshape(len(x), nodes, states - 1)
            top = np.maximum(scores.max(axis=2, initial=0.0), 0.0)
            log_sum = top + np.log(np.exp(scores - top[:, :, None]).sum(axis=2) + np.exp(-top))
            y = z[:, 1:].reshape(scores.shape)
            g += z.T @ ((np.exp(scores - log_sum[:, :, None]) - y) * weight[:, None, None]).reshape(len(x), -1)
            loss += ((log_sum - (scores * y).sum(axis=2)) * weight[:, None]).sum(axis=0)
        i, j = np.indices(g.shape)
        rows = [np.append(i, np.full(nodes, -1)), np.append(j, np.arange(nodes)), np.append(g, loss)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1].astype(np.int32)), pa.array(rows[2])], names=["i", "j", "v"])

    return run


def neighbourhood_sums(counted: DataFrame, parameters: np.ndarray, nodes: int, states: int) -> DataFrame:
    """(i, j, v) summed over observations: the gradient X' (P - Y) of all variables' negative log likelihoods, and at i = -1 the losses.

    ``counted``: x and n. ``parameters``: 1 + nodes * (states - 1) rows of features, nodes * (states - 1) columns of variables and states; a task gives one matrix of that size."""
    return counted.select("x", F.col("n").cast("long").alias("n")).mapInArrow(_sums(parameters, nodes, states), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def _square(counted: DataFrame, nodes: int, states: int) -> np.ndarray:
    """X' X over all observations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = 1 + nodes * (states - 1)
        g = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                z = _indicators(b.column("x").flatten().to_numpy().reshape(b.num_rows, nodes), states)
                g += z.T @ (z * b.column("n").to_numpy().astype(float)[:, None])
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(g.ravel())], names=["i", "j", "v"])

    sums = counted.select("x", F.col("n").cast("long").alias("n")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + nodes * (states - 1),) * 2)
    for r in sums:
        out[r["i"], r["j"]] = r["v"]
    return out


@dataclass
class PathStep:
    """Parameters under one penalty. ``parameters[0]``: intercepts; row block j and column block i: how j's states tell of i's."""

    penalty: float
    parameters: np.ndarray
    losses: np.ndarray
    rounds: int


def neighbourhood_path(observations: DataFrame, nodes: int, states: int, penalties: Sequence[float], rounds: int = 200, tolerance: float = 1e-7) -> list[PathStep]:
    """For each penalty, from the largest, the regressions of every variable on all others with a penalty on the norm of each pair's block: the mean loss
    of each variable plus penalty * sum of norms is least. One job gives a step of all variables; a penalty starts from the one before."""
    counted = cut(observations.groupBy("x").agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 1
    s, d = states - 1, nodes * (states - 1)
    free = np.ones((1 + d, d), bool)
    for i in range(nodes):
        free[1 + i * s : 1 + (i + 1) * s, i * s : (i + 1) * s] = False  # no variable tells of itself
    step = 2.0 / max(float(np.linalg.eigvalsh(_square(counted, nodes, states) / total).max()), 1e-12)
    w, out = np.zeros((1 + d, d)), []
    for penalty in sorted(penalties, reverse=True):
        ahead, t, done, losses = w.copy(), 1.0, 0, np.zeros(nodes)
        for done in range(1, rounds + 1):
            g, losses = np.zeros(w.shape), np.zeros(nodes)
            for r in neighbourhood_sums(counted, ahead, nodes, states).collect():  # as many as there are parameters
                if r["i"] >= 0:
                    g[r["i"], r["j"]] = r["v"] / total
                else:
                    losses[r["j"]] = r["v"] / total
            new = np.where(free, ahead - step * g, 0.0)
            norms = np.sqrt((new[1:].reshape(nodes, s, nodes, s) ** 2).sum(axis=(1, 3)))
            keep = np.maximum(0.0, 1 - step * penalty / np.maximum(norms, 1e-300))
            new[1:] *= np.repeat(np.repeat(keep, s, axis=0), s, axis=1)
            if ((ahead - new) * (new - w)).sum() > 0:  # momentum leads uphill: start it again
                t = 1.0
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, change, t, w = new + (t - 1) / t_new * (new - w), np.abs(new - w).max(), t_new, new
            if change < tolerance:
                break
        out.append(PathStep(penalty, w.copy(), losses, done))
    return out


def block_norms(step: PathStep, nodes: int, states: int) -> np.ndarray:
    """Norm of each pair's couplings: row j, column i, how j tells of i."""
    s = states - 1
    return np.sqrt((step.parameters[1:].reshape(nodes, s, nodes, s) ** 2).sum(axis=(1, 3)))
