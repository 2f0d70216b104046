"""Small dense systems on the driver: their size is that of the columns, not of the rows."""

from __future__ import annotations

import numpy as np

from ..errors import Singular


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive definite system; a pivot of 1e-14 of the largest diagonal or less is Singular."""
    a, n = np.asarray(a, dtype=float), len(b)
    least = max(float(np.max(np.diag(a))) if n else 0.0, 0.0) * 1e-14
    low = np.zeros((n, n))
    for j in range(n):
        pivot = a[j, j] - low[j, :j] @ low[j, :j]
        if not pivot > least:
            raise Singular(f"pivot {j} is {pivot:.3g}")
        low[j, j] = np.sqrt(pivot)
        low[j + 1 :, j] = (a[j + 1 :, j] - low[j + 1 :, :j] @ low[j, :j]) / low[j, j]
    y = np.zeros(n)
    for i in range(n):
        y[i] = (b[i] - low[i, :i] @ y[:i]) / low[i, i]
    x = np.zeros(n)
    for i in reversed(range(n)):
        x[i] = (y[i] - low[i + 1 :, i] @ x[i + 1 :]) / low[i, i]
    return x


def pinv_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric system by its eigenvalues, without those of 1e-10 * max(1, largest) or less."""
    values, vectors = np.linalg.eigh(np.asarray(a, dtype=float))
    keep = np.abs(values) > 1e-10 * max(1.0, float(np.max(values, initial=0.0)))
    return vectors[:, keep] @ ((vectors[:, keep].T @ b) / values[keep])


def solve(a: np.ndarray, b: np.ndarray, solver: str) -> np.ndarray:
    return cholesky_solve(a, b) if solver == "cholesky" else pinv_solve(a, b)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors as rows. Each vector's largest component is positive."""
    values, vectors = np.linalg.eigh(np.asarray(a, dtype=float))
    order = np.argsort(-values, kind="stable")
    values, rows = values[order], vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)])
    return values, rows * np.where(signs == 0, 1.0, signs)[:, None]
