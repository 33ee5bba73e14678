"""Leading eigenvectors of all diagonal blocks of a symmetric matrix at once, to a stated accuracy, with no block in one task.

Rows of a block are dealt to parts of a bounded number of cells. In a step each part gets the vectors of the columns it needs and returns those of its rows. The
driver gets, for each block, the products of a few vectors with each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Cells of a part; vectors beyond those asked for; steps of a filter; accuracy of a vector v, as |G v - t v| by the largest eigenvalue.
PART, MORE, DEGREE, TOLERANCE = 1 << 18, 13, 10, 3e-7

_STATE = "c int, id long, now array<double>, before array<double>"


def _arrays(column, width: int) -> np.ndarray:  # noqa: ANN001
    """The values of a column of arrays of one width, without null ones."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray):  # noqa: ANN202
    import pyarrow as pa

    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def _fresh(ids: np.ndarray, column: int) -> np.ndarray:
    """Numbers from -0.5 to 0.5 that ids and the column's number determine."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(column + 1) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64 - 0.5


def leading_vectors(cells: DataFrame, k: int, part: int = PART, more: int = MORE, tolerance: float = TOLERANCE, most: int = 60) -> DataFrame:
    """(c, id, vec) of the ``k`` largest eigenvalues of each block; ``cells``: (c, id, to, value) with c the block, positive semidefinite, every id with its own diagonal cell.

    Subspace iteration with Chebyshev filters. A block of fewer vectors has zeros for the rest; of equal eigenvalues any vectors of their space are given."""
    wide = k + more
    sizes = cells.groupBy("c").agg(F.ceil(F.count("*") / part).alias("parts"))
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    held = cut(cells.join(F.broadcast(sizes), "c").select(F.col("c").cast("int").alias("c"), mine.alias("part"), "id", "to", "value", "parts"))
    need = cut(held.select("c", "part", F.col("to").alias("id"), "parts").distinct().select("c", "part", "id", (mine == F.col("part")).alias("own")))

    def step(state: DataFrame, times: dict[int, float] | float, now: float, before: float) -> DataFrame:
        """times G x + now x + before y for the vectors x and those before them, y; and x."""

        def run(left, right):  # noqa: ANN001, ANN202
            import pyarrow as pa

            c, ids, own = right["block"][0].as_py(), right["id"].to_numpy(), right["own"].to_numpy()
            x, y = _arrays(right["now"], wide), _arrays(right["before"], wide)
            order, rows = np.argsort(ids), ids[own]
            place = np.argsort(rows)
            to = order[np.searchsorted(ids[order], left["to"].to_numpy())]
            at = place[np.searchsorted(rows[place], left["id"].to_numpy())]
            v, g = left["value"].to_numpy(), np.empty((len(rows), wide))
            for j in range(wide):
                g[:, j] = np.bincount(at, v * x[to, j], len(rows))
            x = x[own]
            out = (times[c] if isinstance(times, dict) else times) * g + now * x + before * y
            return pa.table({"c": pa.array(np.full(len(rows), c, np.int32)), "id": pa.array(rows), "now": _lists(out), "before": _lists(x)})

        sent = need.join(state.select(F.col("c").alias("__c"), F.col("id").alias("__id"), "now", "before"), (F.col("c") == F.col("__c")) & (F.col("id") == F.col("__id"))).select(F.col("c").alias("block"), F.col("part").alias("__p"), "id", "own", "now", F.when(F.col("own"), F.col("before")).alias("before"))
        cells = held.select("c", "part", "id", "to", "value")
        return cells.groupBy("c", "part").cogroup(sent.groupBy("block", "__p")).applyInArrow(run, _STATE)

    def products(state: DataFrame) -> dict[int, np.ndarray]:
        """For each block [V W]'[V W] of its vectors before the step, V, and after it, W."""

        def run(batches) -> Iterator:  # noqa: ANN001
            import pyarrow as pa

            sums: dict[int, np.ndarray] = {}
            for b in batches:
                both, of = np.hstack([_arrays(b.column(2), wide), _arrays(b.column(1), wide)]), b.column(0).to_numpy()
                for c in np.unique(of):
                    z = both[of == c]
                    sums[int(c)] = sums.get(int(c), 0) + z.T @ z
            for c, g in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, c, np.int32)), pa.array(np.arange(g.size, dtype=np.int32)), pa.array(g.ravel())], names=["c", "i", "value"])

        found: dict[int, np.ndarray] = {}
        for r in state.select("c", "now", "before").mapInArrow(run, "c int, i int, value double").groupBy("c", "i").agg(F.sum("value").alias("value")).collect():  # 4 wide^2 numbers a block
            found.setdefault(r["c"], np.zeros((2 * wide) ** 2))[r["i"]] = r["value"]
        return {c: g.reshape(2 * wide, 2 * wide) for c, g in found.items()}

    def turned(state: DataFrame, by: dict[int, np.ndarray], fill: bool) -> DataFrame:
        """The vectors before the last step, turned within their block; columns beyond those of the turn are new ones, or zero."""

        def run(batches) -> Iterator:  # noqa: ANN001
            import pyarrow as pa

            for b in batches:
                of, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _arrays(b.column(2), wide)
                out = np.zeros_like(x)
                for c in np.unique(of):
                    own, z = of == c, by[int(c)]
                    out[own, : z.shape[1]] = x[own] @ z
                    for j in range(z.shape[1], wide if fill else 0):
                        out[own, j] = _fresh(ids[own], j)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(out), _lists(out)], names=["c", "id", "now", "before"])

        return state.select("c", "id", "before").mapInArrow(run, _STATE)

    zeros = F.array_repeat(F.lit(0.0), wide)
    state = held.select("c", "id").distinct().select("c", "id", zeros.alias("now"), zeros.alias("before"))
    blocks = [r["c"] for r in held.select("c").distinct().collect()]
    state = turned(state, {c: np.zeros((wide, 0)) for c in blocks}, True)
    for n in range(most):
        state = cut(step(state, 1.0, 0.0, 0.0))
        by, bounds, done = {}, {}, True
        for c, g in products(state).items():
            z, values, errors = _ritz(g, wide)
            by[c] = z
            top, low = values[min(k, len(values)) - 1] if len(values) else 0.0, values[-1] if len(values) else 0.0
            scale = values[0] if len(values) and values[0] > 0 else 1.0
            done = done and bool((errors[:k] <= tolerance * scale).all())
            bounds[c] = max(low if low < 0.99 * top else 0.95 * top, 1e-3 * scale)
        if done:
            return turned(state, by, False).select("c", "id", F.slice("now", 1, k).alias("vec"))
        state = turned(state, by, True)
        state = step(state, {c: 2 / b for c, b in bounds.items()}, -1.0, 0.0)
        for _ in range(1, DEGREE if n else 4):
            state = step(state, {c: 4 / b for c, b in bounds.items()}, -2.0, -1.0)
    raise ArithmeticError(f"leading vectors not found to {tolerance} in {most} rounds")


def _ritz(g: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From [V GV]'[V GV]: the turn to eigenvectors within the space of V, their values in descending order, and the lengths of G v - t v."""
    s, h, q = g[:wide, :wide], g[:wide, wide:], g[wide:, wide:]
    d = np.diag(s)
    d = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
    w, u = np.linalg.eigh(d[:, None] * s * d)
    keep = w > max(w.max(), 0) * 1e-10
    r = d[:, None] * u[:, keep] / np.sqrt(w[keep])
    m = r.T @ h @ r
    t, e = np.linalg.eigh((m + m.T) / 2)
    t, z = t[::-1], (r @ e)[:, ::-1]
    return z, t, np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", z, q, z) - t * t, 0))
