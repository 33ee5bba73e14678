"""Non-negative factorisation by projected Newton steps on each row's free set.

With one factor fixed, every row b of the other solves min 1/2 b G b' - t b, b >= 0, with G the fixed factor's Gram matrix and t the row
of the matrix times it. G, k by k, is all that rows share; t is a grouped sum. Components that stand at 0 with a gradient
that would take them below are held there; the others, the row's free set, move along the Newton step of their own part of G, are projected,
and the step is halved as long as the row's value rises. ``exact`` repeats this until the row is optimal, otherwise one step is taken.
Rows of one free set are solved together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import CoordMatrix
from ..session import cut
from .factor import gram, nmf_objective, nonnegative_start, times_factors


def newton_rows(b: np.ndarray, t: np.ndarray, g: np.ndarray, steps: int, tolerance: float = 1e-12) -> np.ndarray:
    """Rows of ``b`` after at most ``steps`` steps towards their least 1/2 b G b' - t b over b >= 0."""
    b, k = np.maximum(b, 0.0), g.shape[0]
    scale = np.abs(t).max(axis=1, initial=0.0, keepdims=True) + 1e-300
    value = lambda x, r: 0.5 * ((x @ g) * x).sum(axis=1) - (t[r] * x).sum(axis=1)
    for _ in range(steps):
        slope = b @ g - t
        free = (b > 0) | (slope < -tolerance * scale)
        active = np.flatnonzero((np.abs(np.where(free, slope, 0.0)) > tolerance * scale).any(axis=1))
        if not len(active):
            break
        move = np.zeros((len(active), k))
        sets, which = np.unique(free[active], axis=0, return_inverse=True)
        for n, on in enumerate(sets):
            rows = np.flatnonzero(which.ravel() == n)
            move[np.ix_(rows, on)] = -slope[np.ix_(active[rows], on)] @ np.linalg.pinv(g[np.ix_(on, on)], hermitian=True)
        before, step = value(b[active], active), np.ones(len(active))
        new = np.maximum(b[active] + move, 0.0)
        for _ in range(60):
            worse = value(new, active) > before
            if not worse.any():
                break
            step[worse] /= 2
            new[worse] = np.maximum(b[active][worse] + step[worse, None] * move[worse], 0.0)
        else:
            new[worse] = b[active][worse]
        b[active] = new
    return b


def _stepped(g: np.ndarray, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = g.shape[0]
        for batch in batches:
            b, t = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k) for c in (1, 2))
            new = newton_rows(b, t, g, steps)
            lists = pa.ListArray.from_arrays(np.arange(0, new.size + 1, k, dtype=np.int32), pa.array(new.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "vec"])

    return run


def updated(m: CoordMatrix, mine: DataFrame, other: DataFrame, k: int, exact: bool = False, steps: int = 50) -> DataFrame:
    """(id, vec): the rows of ``mine`` improved with ``other`` fixed, A ~ mine other'."""
    zero = F.array(*[F.lit(0.0)] * k)
    rows = mine.join(times_factors(m, other, k).withColumnRenamed("vec", "t"), "id", "left").select("id", "vec", F.coalesce("t", zero).alias("t"))
    return rows.mapInArrow(_stepped(gram(other, k), steps if exact else 1), "id long, vec array<double>")


def residuals(m: CoordMatrix, mine: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(id, residual): how far each row is from its optimum, the length of min(b, b G - t) by component; 0 for optimal rows."""
    g = gram(other, k)
    zero = F.array(*[F.lit(0.0)] * k)
    rows = mine.join(times_factors(m, other, k).withColumnRenamed("vec", "t"), "id", "left").select("id", "vec", F.coalesce("t", zero).alias("t"))
    slope = lambda c: sum((F.get("vec", F.lit(x)) * float(g[x, c]) for x in range(k)), F.lit(0.0)) - F.get("t", F.lit(c))
    part = lambda c: F.least(F.get("vec", F.lit(c)), slope(c))
    return rows.select("id", F.sqrt(sum((part(c) * part(c) for c in range(k)), F.lit(0.0))).alias("residual"))


def active_set_nmf(m: CoordMatrix, k: int, rounds: int = 5, exact: bool = False) -> tuple[DataFrame, DataFrame, list[float]]:
    """B, C and |A - BC'|^2 by round, which never rises."""
    m = CoordMatrix(cut(m.cells.select("row", "col", "value")), m.n_rows, m.n_cols)
    t, b, c, history = m.transpose(), cut(nonnegative_start(m, k, "row")), cut(nonnegative_start(m, k, "col")), []
    for _ in range(rounds):
        b = cut(updated(m, b, c, k, exact))
        c = cut(updated(t, c, b, k, exact))
        history.append(nmf_objective(m, b, c, k))
    return b, c, history
