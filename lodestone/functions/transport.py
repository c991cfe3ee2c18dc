"""Entropic optimal transport and proportional fitting (numpy)."""

from __future__ import annotations

import numpy as np


def sinkhorn(a: np.ndarray, b: np.ndarray, cost: np.ndarray, epsilon: float, lambda_a: float | None = None, lambda_b: float | None = None, rounds: int = 1000, stop: float = 1e-9) -> np.ndarray:
    """Transport plan between weights a and b. A side with a lambda is relaxed: its marginal may deviate at that price.
    Works on logarithms, so that small epsilon doesn't underflow."""
    k = -cost / epsilon
    fa = 1.0 if lambda_a is None else lambda_a / (lambda_a + epsilon)
    fb = 1.0 if lambda_b is None else lambda_b / (lambda_b + epsilon)
    with np.errstate(divide="ignore"):
        la, lb = np.log(a), np.log(b)

    def lse(x, axis):
        top = x.max(axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

    u, v = np.zeros(len(a)), np.zeros(len(b))
    for n in range(rounds):
        before = u, v
        u = fa * (la - lse(k + v, 1))
        v = fb * (lb - lse(k + u[:, None], 0))
        if n % 10 == 0:
            gap = max(np.abs(u - before[0])[np.isfinite(u)].max(initial=0), np.abs(v - before[1])[np.isfinite(v)].max(initial=0))
            if gap < stop:
                break
    return np.exp(u[:, None] + k + v)


def fit_marginals(x: np.ndarray, u: np.ndarray, v: np.ndarray, delta: float = 1e-5, rounds: int = 100) -> np.ndarray:
    """x scaled by rows and columns to row sums u and column sums v (iterative proportional fitting)."""
    a, b = np.ones(len(u)), np.ones(len(v))
    for n in range(rounds):
        before = a, b
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.nan_to_num(u / (x @ b), posinf=0)
            b = np.nan_to_num(v / (x.T @ a), posinf=0)
            change = max(np.abs(np.nan_to_num(p / q - 1, posinf=0, neginf=0)).max(initial=0) for p, q in ((a, before[0]), (b, before[1])))
        if n >= 2 and change < delta:
            break
    return a[:, None] * x * b


def fit_rows(m: np.ndarray, u: np.ndarray, v: np.ndarray, delta: float = 1e-5, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Scalings a, b for many problems that share the matrix m: a[r, i] m[i, j] b[r, j] has row sums u[r] and column sums v[r].
    As ``fit_marginals`` where u and v are positive; a problem stops changing once its own scalings settle."""
    a, b = np.ones_like(u), np.where(v > 0, 1.0, 0.0)
    todo = np.arange(len(u))
    for n in range(rounds):
        before = a[todo], b[todo]
        with np.errstate(divide="ignore", invalid="ignore"):
            a[todo] = np.nan_to_num(u[todo] / (b[todo] @ m.T), posinf=0)
            b[todo] = np.nan_to_num(v[todo] / (a[todo] @ m), posinf=0)
            change = np.max([np.abs(np.nan_to_num(p / q - 1, posinf=0, neginf=0)).max(1, initial=0) for p, q in ((a[todo], before[0]), (b[todo], before[1]))], axis=0)
        if n >= 2:
            todo = todo[change >= delta]
        if not len(todo):
            break
    return a, b


def minimal_transitions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least mass that must move from each entry of distribution a to each of b: what stays stays, the excess goes to the
    entries that lack, in proportion."""
    stay = np.minimum(a, b)
    excess, lack = a - stay, b - stay
    moved = excess.sum()
    out = np.diag(stay)
    return out + (np.outer(excess, lack) / moved if moved > 0 else 0)


def nmf(x: np.ndarray, k: int, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors w, h with x ~ w h, by multiplicative updates."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt(max(x.mean(), 1e-12) / k)
    w, h = scale * rng.random((x.shape[0], k)) + 1e-6, scale * rng.random((k, x.shape[1])) + 1e-6
    for _ in range(rounds):
        h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
        w *= (x @ h.T) / (w @ (h @ h.T) + 1e-12)
    return w, h


def kmeans(x: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Labels of k clusters; starts from points far apart."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    centers = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
    c, label = np.array(centers), None
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1) if len(x) * k * x.shape[1] < 5e7 else ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
    return label
