"""Non-negative least squares (numpy)."""

from __future__ import annotations

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """w >= 0 with the least |a w - b|, by an active set."""
    return _active_set(a.T @ a, a.T @ b, rounds)


def _active_set(gram: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    n = len(gram)
    w, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-12 * max(1.0, float(np.abs(gram).max(initial=0)))
    for _ in range(rounds or 5 * n + 10):
        slope = target - gram @ w
        slope[free] = -np.inf
        k = int(slope.argmax())
        if free.all() or slope[k] <= tolerance:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            step = np.zeros(n)
            step[at] = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (step[at] > 0).all():
                w = step
                break
            falls = at[step[at] <= 0]
            t = min(1.0, float((w[falls] / np.maximum(w[falls] - step[falls], 1e-300)).min()))
            w = w + t * (step - w)
            free &= w > 1e-15
            w[~free] = 0
            if not free.any():
                break
    return w


def nnls_rows(gram: np.ndarray, targets: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For every row t of ``targets`` the w >= 0 with the least w gram w / 2 - w t; all rows share the Gram matrix.

    Block principal pivoting on all rows at once: variables of the wrong sign change sides together, or the last of them
    alone where that does not help. Rows for which it does not end, or the Gram matrix is singular, go to the active set."""
    m, n = targets.shape
    w, out = np.zeros((m, n)), np.zeros((m, n))
    if not m or not n:
        return out
    scale = max(float(np.diag(gram).max()), 1e-300)
    gram, targets = gram / scale, targets / scale
    free = np.zeros((m, n), bool)
    slope = -targets
    chances, fewest = np.full(m, 3), np.full(m, n + 1)
    tolerance = 1e-12 * np.maximum(1e-3, np.abs(targets).max(1, keepdims=True))
    todo = np.arange(m)
    step = max(1, 4_000_000 // (n * n))
    for _ in range(rounds):
        wrong = (free[todo] & (w[todo] < -tolerance[todo])) | (~free[todo] & (slope[todo] < -tolerance[todo]))
        count = wrong.sum(1)
        todo, wrong, count = todo[count > 0], wrong[count > 0], count[count > 0]
        if not len(todo):
            break
        better = count < fewest[todo]
        fewest[todo[better]], chances[todo[better]] = count[better], 3
        chances[todo[~better]] -= 1
        single = chances[todo] < 0
        if single.any():
            last = n - 1 - np.argmax(wrong[single][:, ::-1], axis=1)
            wrong[single] = False
            wrong[np.flatnonzero(single), last] = True
        free[todo] ^= wrong
        for a in range(0, len(todo), step):
            part = todo[a : a + step]
            f = free[part]
            system = np.where(f[:, :, None] & f[:, None, :], gram, 0.0)
            system[:, np.arange(n), np.arange(n)] += ~f
            try:
                w[part] = np.linalg.solve(system, np.where(f, targets[part], 0.0)[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                w[part] = np.nan
            slope[part] = np.where(f, 0.0, w[part] @ gram - targets[part])
    out = np.maximum(w, 0.0)
    bad = np.zeros(m, bool)
    bad[todo] = True
    bad |= ~np.isfinite(w).all(1)
    for r in np.flatnonzero(bad):
        out[r] = _active_set(gram, targets[r])
    return out
