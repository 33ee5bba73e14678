"""Dense linear algebra of small matrices on the driver."""

from __future__ import annotations

import numpy as np


def gram_schmidt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R by modified Gram-Schmidt."""
    q, n = np.array(a, float), a.shape[1]
    r = np.zeros((n, n))
    for i in range(n):
        r[i, i] = np.linalg.norm(q[:, i])
        q[:, i] /= r[i, i] or 1.0
        r[i, i + 1 :] = q[:, i] @ q[:, i + 1 :]
        q[:, i + 1 :] -= np.outer(q[:, i], r[i, i + 1 :])
    return q, r


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reflection vectors (columns) and R."""
    r, (m, n) = np.array(a, float), a.shape
    w = np.zeros((m, n))
    for k in range(min(m, n)):
        v = r[k:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
            w[k:, k] = v
    return w, np.triu(r[:n])


def reflections_to_q(w: np.ndarray) -> np.ndarray:
    q = np.eye(w.shape[0])
    for k in reversed(range(w.shape[1])):
        q -= 2 * np.outer(w[:, k], w[:, k] @ q)
    return q


def lu(a: np.ndarray, complete: bool = False) -> tuple[np.ndarray, ...]:
    """L, U and the row order (and the column order with ``complete`` pivoting): A[rows][:, cols] = L U."""
    u, n = np.array(a, float), len(a)
    lower, rows, cols = np.eye(n), np.arange(n), np.arange(n)
    for k in range(n - 1):
        if complete:
            i, j = np.unravel_index(np.abs(u[k:, k:]).argmax(), (n - k, n - k))
            u[:, [k, k + j]], cols[[k, k + j]] = u[:, [k + j, k]], cols[[k + j, k]]
        else:
            i = np.abs(u[k:, k]).argmax()
        i += k
        u[[k, i]], rows[[k, i]] = u[[i, k]], rows[[i, k]]
        lower[[k, i], :k] = lower[[i, k], :k]
        if u[k, k]:
            lower[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(lower[k + 1 :, k], u[k])
    return (lower, np.triu(u), rows, cols) if complete else (lower, np.triu(u), rows)


def tridiagonal_eigenvector(a: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of a tridiagonal matrix for a known eigenvalue, by substitution from 1."""
    n = len(a)
    x = np.ones(n)
    for i in range(n - 1):
        before = a[i, i - 1] * x[i - 1] if i else 0.0
        x[i + 1] = ((value - a[i, i]) * x[i] - before) / a[i, i + 1]
    return x / np.linalg.norm(x)


def is_positive_definite(a: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return False
    return True


def power_method(a: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    x = np.ones(len(a)) / np.sqrt(len(a))
    for _ in range(rounds):
        y = a @ x
        x = y / (np.linalg.norm(y) or 1.0)
    return float(x @ a @ x), x


def svd_by_qr(a: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Singular values by QR of the matrix and its transpose in turn."""
    r = np.array(a, float)
    for _ in range(rounds):
        r = np.linalg.qr(r.T)[1]
    return np.sort(np.abs(np.diag(r)))[::-1]
