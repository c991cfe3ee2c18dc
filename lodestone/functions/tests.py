"""Tails of test statistics (plain Python)."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

import numpy as np


def log_choose(n: float, k: float) -> float:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def fisher(a: int, b: int, c: int, d: int, alternative: str = "greater") -> float:
    """Hypergeometric tail of the table [[a, b], [c, d]]."""
    row, col, total = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - total), min(row, col)
    if alternative == "two-sided":
        terms = [log_choose(col, k) + log_choose(total - col, row - k) - log_choose(total, row) for k in range(lo, hi + 1)]
        own = terms[a - lo]
        return min(1.0, sum(exp(t) for t in terms if t <= own + 1e-7))
    span = range(a, hi + 1) if alternative == "greater" else range(lo, a + 1)
    return min(1.0, sum(exp(log_choose(col, k) + log_choose(total - col, row - k) - log_choose(total, row)) for k in span))


def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """Numbers of arrangements of two samples by U, without ties."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    # items of rank 1..n1+n2; choosing rank r as the i-th of the first sample adds r - i to U
    for r in range(1, n1 + n2 + 1):
        for i in range(min(r, n1), 0, -1):
            gain = r - i
            if gain <= n2:
                ways[i, gain:] += ways[i - 1, : ways.shape[1] - gain]
    return ways[n1]


def mann_whitney(u: float, n1: int, n2: int, ties: float, exact_below: int = 400) -> float:
    """P(U >= u): by enumeration where n1 n2 is small (as if there were no ties), else normal with continuity and tie
    correction; ties is the sum of t^3 - t."""
    if n1 * n2 < exact_below:
        counts = rank_sum_counts(n1, n2)
        return float(counts[int(np.ceil(u)) :].sum() / counts.sum())
    n = n1 + n2
    sd = sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    if sd == 0:
        return 1.0
    return 0.5 * erfc((u - n1 * n2 / 2 - 0.5) / sd / sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """P(T >= t)."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half
