"""Small optimisers that run on the driver; objectives may be evaluated on DataFrames."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Options:
    """Defaults of the solvers."""

    rounds: int = 100
    memory: int = 7
    gradient: float = 1e-6
    progress: float = 1e-9
    armijo: float = 0.01
    shrink: float = 0.5


def backtrack(f: Callable, x: np.ndarray, fx: float, g: np.ndarray, d: np.ndarray, o: Options = Options(), start: float = 1.0) -> float:
    """A step with f(x + t d) <= f(x) + c t g'd; 0 if none above e^-16 is found."""
    t, slope = start, float(g @ d)
    while t > np.exp(-16):
        if f(x + t * d) <= fx + o.armijo * t * slope:
            return t
        t *= o.shrink
    return 0.0


def lbfgs(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], x0, low=None, high=None, o: Options = Options(), callback: Callable | None = None) -> tuple[np.ndarray, float, str]:
    """Limited-memory BFGS with optional box bounds, which hold by projection. Returns x, f and why it stopped."""
    clip = lambda x: np.clip(x, -np.inf if low is None else low, np.inf if high is None else high)
    x = clip(np.array(x0, float))
    fx, g = fn(x)
    s_list, y_list = [], []
    for k in range(o.rounds):
        bound = np.zeros(len(x), bool)
        if low is not None:
            bound |= (x <= np.asarray(low)) & (g > 0)
        if high is not None:
            bound |= (x >= np.asarray(high)) & (g < 0)
        free = np.where(bound, 0.0, g)
        if np.abs(free).max(initial=0) <= o.gradient:
            return x, fx, "gradient"
        q, alphas = free.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for s, y, a in zip(s_list, y_list, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        d = np.where(bound, 0.0, -q)
        if d @ free >= 0:
            d, s_list, y_list = -free, [], []
        t = 1.0 if s_list else min(1.0, 1.0 / max(np.abs(d).max(), 1e-12))
        while True:
            new = clip(x + t * d)
            f_new, g_new = fn(new)
            if f_new <= fx + 1e-4 * (free @ (new - x)) or t < 1e-16:
                break
            t *= o.shrink
        s, y = new - x, g_new - g
        if callback and callback(new, k):
            return new, f_new, "callback"
        if abs(fx - f_new) <= o.progress * max(1.0, abs(fx)):
            return new, f_new, "progress"
        if s @ y > 1e-12:
            s_list, y_list = (s_list + [s])[-o.memory :], (y_list + [y])[-o.memory :]
        x, fx, g = new, f_new, g_new
    return x, fx, "rounds"


def barzilai_borwein(fn: Callable, x0, o: Options = Options(), project: Callable = lambda x: x) -> tuple[np.ndarray, float]:
    """Gradient steps of length s's/s'y, projected; the best point seen is returned."""
    x = project(np.array(x0, float))
    fx, g = fn(x)
    best, step = (fx, x), 1.0 / max(1.0, np.abs(g).max(initial=0))
    for _ in range(o.rounds * 10):
        new = project(x - step * g)
        f_new, g_new = fn(new)
        s, y = new - x, g_new - g
        if np.abs(s).max(initial=0) <= o.progress:
            break
        step = (s @ s) / (s @ y) if s @ y > 0 else step
        x, g = new, g_new
        if f_new < best[0]:
            best = (f_new, x)
    return best[1], best[0]


def nnls(a: np.ndarray, b: np.ndarray, method: str = "active", o: Options = Options()) -> np.ndarray:
    """min |Ax - b|, x >= 0. Methods: active (Lawson-Hanson), lbfgs and bb (projected)."""
    if method == "active":
        return nnls_gram(a.T @ a, a.T @ b)
    fn = lambda x: (0.5 * float(((a @ x - b) ** 2).sum()), a.T @ (a @ x - b))
    zero = np.zeros(a.shape[1])
    if method == "lbfgs":
        return lbfgs(fn, zero, low=zero, o=o)[0]
    if method == "bb":
        return barzilai_borwein(fn, zero, o, lambda x: np.maximum(x, 0))[0]
    raise ValueError(f"unknown method {method}")


def nnls_gram(g: np.ndarray, y: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Active-set solution from the normal equations G x = y."""
    n = len(y)
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n + 10):
        w = y - g @ x
        w[active] = -np.inf
        if not n or w.max() <= tolerance * max(1.0, np.abs(y).max()):
            break
        active[int(w.argmax())] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(g[np.ix_(active, active)], y[active], rcond=None)[0]
            if (z[active] > 0).all():
                x = z
                break
            down = active & (z <= 0)
            ratio = x[down] / (x[down] - z[down])
            x = x + ratio.min() * (z - x)
            active &= x > tolerance
            x[~active] = 0
    return x


def kl_regression(a: np.ndarray, b: np.ndarray, o: Options = Options()) -> np.ndarray:
    """min KL(b, Ax), x >= 0."""

    def fn(x: np.ndarray) -> tuple[float, np.ndarray]:
        fit = a @ x + 1e-12
        return float((np.where(b > 0, b * np.log(np.where(b > 0, b, 1) / fit), 0) - b + fit).sum()), a.T @ (1 - b / fit)

    one = np.ones(a.shape[1])
    return lbfgs(fn, one, low=0 * one, o=o)[0]


def minimise_until_rise(domain: Sequence[float], f: Callable[[float], float]) -> tuple[float, float]:
    """(least value, x) along an ordered grid, stopping at the first rise."""
    best = None
    for x in domain:
        v = f(x)
        if best is not None and v > best[0]:
            break
        if best is None or v < best[0]:
            best = (v, x)
    return best


def minimise_grid(domains: Sequence[Sequence[float]], f: Callable[..., float]) -> tuple[float, tuple]:
    """(least value, point) over all points of a grid, the first of equal ones."""
    return min(((f(*p), p) for p in itertools.product(*domains)), key=lambda x: x[0])


def bisect(f: Callable[[float], float], target: float, low: float, high: float, gap: float = 1e-4) -> float:
    """x with f(x) near ``target`` for a rising f; the ends where the target lies outside."""
    if f(low) >= target:
        return low
    if f(high) <= target:
        return high
    while high - low > gap:
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def newton(f: Callable, gradient: Callable, hessian: Callable, x0, o: Options = Options()) -> np.ndarray:
    x = np.array(x0, float)
    for _ in range(o.rounds):
        g = gradient(x)
        d = -np.linalg.solve(hessian(x), g)
        if -(g @ d) / 2 <= o.progress:
            break
        x = x + backtrack(f, x, f(x), g, d, o) * d
    return x


def steepest(f: Callable, gradient: Callable, x0, o: Options = Options()) -> np.ndarray:
    x = np.array(x0, float)
    for _ in range(o.rounds * 100):
        g = gradient(x)
        if np.abs(g).max() <= o.gradient:
            break
        t = backtrack(f, x, f(x), g, -g, o, start=2.0)
        if t == 0:
            break
        x = x - t * g
    return x


def barrier(f: Callable, constraints: Sequence[Callable], x0, weight: float = 1.0, boost: float = 10.0, rounds: int = 8) -> np.ndarray:
    """min f subject to c(x) < 0 for all constraints, by a growing weight of f against the log barrier; numeric gradients."""

    def slope(h: Callable, x: np.ndarray) -> np.ndarray:
        e = 1e-6
        return np.array([(h(x + e * d) - h(x - e * d)) / (2 * e) for d in np.eye(len(x))])

    x = np.array(x0, float)
    for _ in range(rounds):

        def whole(z: np.ndarray, w: float = weight) -> float:
            c = np.array([k(z) for k in constraints])
            return np.inf if (c >= 0).any() else w * f(z) - np.log(-c).sum()

        x = steepest(whole, lambda z: slope(whole, z), x, Options(rounds=3, gradient=1e-4))
        weight *= boost
    return x


def tradeoffs(solve: Callable[[float], tuple[float, float]], step: float = 0.02) -> list[tuple[float, float, float]]:
    """(w, first, second objective) of the scalarised problem for w from 0 to 1."""
    return [(w, *solve(w)) for w in np.arange(0, 1 + step / 2, step).tolist()]


def rosenbrock(x: np.ndarray) -> tuple[float, np.ndarray]:
    a, b = x[:-1], x[1:]
    g = np.zeros(len(x))
    g[:-1] = -400 * a * (b - a * a) - 2 * (1 - a)
    g[1:] += 200 * (b - a * a)
    return float((100 * (b - a * a) ** 2 + (1 - a) ** 2).sum()), g
