"""Distances and projections between the rows of two long matrices.

The second matrix, usually profiles, is meant to be the small one: up to ``packed.ENTRIES`` entries (zeros included) it is sent
to the workers, and blocks of rows of the first are multiplied with it. Beyond that size, both sides are joined on the
variable by a shuffle. Rows are normalised to sum 1 for all metrics but euclidean and cosine; rows that sum to 0 share
nothing with others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.nnls import nnls_rows
from lodestone.operators.elementwise import normalise
from lodestone.operators.packed import Rows, fetch, kind, long, packed, per_block, small

RAW = ("euclidean", "cosine")
ROOTS = ("bc", "bc2", "h2", "hellinger")
DISTANCES = ("euclidean", "cosine", "naive", "projection", "bc", "h2", "bc2", "hellinger", "kl")
OVERLAPS = ("cosine", "naive", "bc", "bc2", "nwsp", "weighted")


def _share(v: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.divide(v, sums, out=np.zeros_like(v), where=sums != 0)


def distance_kernel(b: np.ndarray, metric: str) -> Callable[[Rows], np.ndarray]:
    """Distances of a block's rows to the columns of b (variables by rows of the small side)."""
    if metric in RAW:
        bb = (b * b).sum(0)

        def run(r: Rows) -> np.ndarray:
            aa, ab = r.sums(np.square)[:, None], r.block @ b
            return np.sqrt(np.maximum(0, aa + bb - 2 * ab)) if metric == "euclidean" else np.maximum(0, 1 - _share(ab, np.sqrt(aa * bb)))

        return run
    q = _share(b, b.sum(0))
    if metric == "kl":
        logs = np.log(q, out=np.zeros_like(q), where=q > 0)

        def run(r: Rows) -> np.ndarray:
            s = r.sums()
            p = _share(r.x, s[r.row])
            own = np.bincount(r.row, p * np.log(p, out=np.zeros_like(p), where=p > 0), len(r.names))
            return _share(r.block, s[:, None]) @ logs - own[:, None]

        return run
    root = metric in ROOTS
    q = np.sqrt(q) if root else q
    finish = {"bc2": lambda ab: np.maximum(0, 1 - ab * ab), "hellinger": lambda ab: np.sqrt(np.maximum(0, 1 - ab))}.get(metric, lambda ab: np.maximum(0, 1 - ab))

    def run(r: Rows) -> np.ndarray:
        p = _share(r.block, r.sums()[:, None])
        return finish((np.sqrt(p) if root else p) @ q)

    return run


def overlap_kernel(b: np.ndarray, metric: str) -> Callable[[Rows], tuple[np.ndarray, np.ndarray]]:
    """(similarities, which of the pairs share a variable) of a block's rows with the columns of b."""
    if metric not in OVERLAPS:
        raise ValueError(f"unknown metric {metric!r}")
    stored = (b != 0).astype(float)
    q = b if metric == "cosine" else _share(b, b.sum(0))
    mean = q.mean(1, keepdims=True) if q.shape[1] else np.zeros((len(q), 1))
    weight = _share(np.ones_like(mean), mean)
    norm = np.sqrt((b * b).sum(0)) if metric == "cosine" else np.sqrt((q * q * weight).sum(0))
    right = {"bc": np.sqrt(q), "bc2": np.sqrt(q), "nwsp": q * weight, "weighted": q * weight}.get(metric, q)

    def run(r: Rows) -> tuple[np.ndarray, np.ndarray]:
        met = (r.block != 0).astype(float) @ stored > 0
        if metric == "cosine":
            return _share(r.block @ right, np.sqrt(r.sums(np.square))[:, None] * norm), met
        p = _share(r.block, r.sums()[:, None])
        ab = (np.sqrt(p) if metric in ("bc", "bc2") else p) @ right
        if metric == "bc2":
            ab = ab * ab
        elif metric == "nwsp":
            ab = _share(ab, ab.sum(1, keepdims=True))
        elif metric == "weighted":
            ab = _share(ab, np.sqrt((p * p) @ weight) * norm)
        return ab, met

    return run


def gemm(a: DataFrame, b: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(i, j, value): A B^T at the pairs that share a variable, optionally only at the (i, j) of a mask."""
    if mask is not None:
        left = mask.select("i", "j").join(a.select(F.col("obs").alias("i"), "var", F.col("value").alias("a")), "i")
        return left.join(b.select(F.col("obs").alias("j"), "var", F.col("value").alias("b")), ["j", "var"]).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))
    got = fetch(b, "var", "obs", "value")
    if got is None:
        return _pairs(a, b, F.col("a") * F.col("b"), "value")
    m, var, names = got
    stored = (m != 0).astype(float)
    run = lambda r: long(r.names, names, r.block @ m, (r.block != 0).astype(float) @ stored > 0, ("i", "j", "value"))
    return per_block(packed(a, var), len(var), run, f"i {kind(a)}, j string, value double")


def cdist(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(i, j, distance) of all rows of a and b. kl has the sign of ``sum p ln q - sum p ln p`` over the entries of both."""
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric!r}")
    got = fetch(b, "var", "obs", "value")
    if got is None:
        return cdist_joined(a, b, metric)
    m, var, names = got
    kernel = distance_kernel(m, metric)
    return per_block(packed(a, var), len(var), lambda r: long(r.names, names, kernel(r), None, ("i", "j", "distance")), f"i {kind(a)}, j string, distance double")


def overlap(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(i, j, value): similarity of rows by cosine, naive, bc, bc2, nwsp (variables weighted by the inverse of b's mean
    profile; rows normalised) or weighted (the same, by norms)."""
    if metric not in OVERLAPS:
        raise ValueError(f"unknown metric {metric!r}")
    got = fetch(b, "var", "obs", "value")
    if got is None:
        return overlap_joined(a, b, metric)
    m, var, names = got
    kernel = overlap_kernel(m, metric)
    return per_block(packed(a, var), len(var), lambda r: long(r.names, names, *kernel(r), ("i", "j", "value")), f"i {kind(a)}, j string, value double")


def _pairs(a: DataFrame, b: DataFrame, product, alias="ab") -> DataFrame:
    """Every (i, j) that shares a variable, with the summed product."""
    right = b.select("var", F.col("obs").alias("j"), F.col("value").alias("b")).hint("merge")
    return a.select("var", F.col("obs").alias("i"), F.col("value").alias("a")).join(right, "var").groupBy("i", "j").agg(F.sum(product).alias(alias))


def _norms(x: DataFrame, name: str, alias: str) -> DataFrame:
    return x.groupBy(F.col("obs").alias(name)).agg(F.sum(F.col("value") * F.col("value")).alias(alias))


def cdist_joined(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """``cdist`` of two large sides. The result is all pairs by definition."""
    zero = lambda c: F.greatest(F.lit(0.0), c)
    ab = F.col("ab")
    grid = lambda p, q, pairs: p.crossJoin(q).join(pairs, ["i", "j"], "left").fillna(0.0)
    if metric in RAW:
        g = grid(_norms(a, "i", "aa"), _norms(b, "j", "bb"), _pairs(a, b, F.col("a") * F.col("b")))
        d = F.sqrt(zero(F.col("aa") + F.col("bb") - 2 * ab)) if metric == "euclidean" else zero(1 - F.coalesce(F.try_divide(ab, F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)))
        return g.select("i", "j", d.alias("distance"))
    a, b = normalise(a, "obs", "value"), normalise(b, "obs", "value")
    if metric == "kl":
        own = a.groupBy(F.col("obs").alias("i")).agg(F.sum(F.col("value") * F.log("value")).alias("aa"))
        g = grid(own, b.select(F.col("obs").alias("j")).distinct(), _pairs(a, b, F.col("a") * F.log("b")))
        return g.select("i", "j", (ab - F.col("aa")).alias("distance"))
    product = F.sqrt(F.col("a") * F.col("b")) if metric in ROOTS else F.col("a") * F.col("b")
    g = grid(a.select(F.col("obs").alias("i")).distinct(), b.select(F.col("obs").alias("j")).distinct(), _pairs(a, b, product))
    d = {"bc2": zero(1 - ab * ab), "hellinger": F.sqrt(zero(1 - ab))}.get(metric, zero(1 - ab))
    return g.select("i", "j", d.alias("distance"))


def overlap_joined(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """``overlap`` of two large sides."""
    if metric == "cosine":
        n = _pairs(a, b, F.col("a") * F.col("b")).join(_norms(a, "i", "aa"), "i").join(_norms(b, "j", "bb"), "j")
        return n.select("i", "j", F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("value"))
    a, b = normalise(a, "obs", "value"), normalise(b, "obs", "value")
    if metric in ("bc", "bc2"):
        s = _pairs(a, b, F.sqrt(F.col("a") * F.col("b")))
        return s.select("i", "j", (F.col("ab") if metric == "bc" else F.col("ab") * F.col("ab")).alias("value"))
    if metric == "naive":
        return _pairs(a, b, F.col("a") * F.col("b"), "value")
    k = b.select("obs").distinct().count()
    mean = b.groupBy("var").agg((F.sum("value") / k).alias("m"))
    s = _pairs(a, b.join(mean, "var").select("obs", "var", F.try_divide("value", "m").alias("value")), F.col("a") * F.col("b"))
    if metric == "nwsp":
        total = s.groupBy("i").agg(F.sum("ab").alias("t"))
        return s.join(total, "i").select("i", "j", F.try_divide("ab", "t").alias("value"))
    norm = lambda x, n, out: x.join(mean, "var").groupBy(F.col("obs").alias(n)).agg(F.sqrt(F.sum(F.col("value") * F.col("value") / F.col("m"))).alias(out))
    return s.join(norm(a, "i", "aa"), "i").join(norm(b, "j", "bb"), "j").select("i", "j", F.try_divide("ab", F.col("aa") * F.col("bb")).alias("value"))


def freed(cross: np.ndarray, how: str) -> Callable[[np.ndarray], np.ndarray]:
    """Turns rows of values into the w with value_j = sum_i w_i cross_ij, by least squares ('linear') or non-negative ('nnls')."""
    if how == "linear":
        inverse = np.linalg.pinv(cross)
        return lambda v: v @ inverse
    return lambda v: nnls_rows(cross @ cross.T, v @ cross.T)


def deconvolve(values: DataFrame, cross: DataFrame, how: str) -> DataFrame:
    """Similarities (i, j, value) freed of cross-talk between the rows of b: (obs, category, weight). ``cross`` (i, j, value), the
    values j of row i of b itself, is categories by categories, of checked size."""
    m, rows, columns = small(cross, "i", "j", "value", "table of overlaps")
    names = sorted(set(rows) | set(columns))
    full = np.zeros((len(names), len(names)))
    full[np.ix_(np.searchsorted(names, rows), np.searchsorted(names, columns))] = m
    solve = freed(full, how)
    x = values.select(F.col("i").alias("obs"), F.col("j").alias("var"), "value")
    return per_block(packed(x, names), len(names), lambda r: long(r.names, names, solve(r.block), None, ("obs", "category", "weight")), f"obs {kind(x)}, category string, weight double")
