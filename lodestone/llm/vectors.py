"""Rows of a long count matrix as vectors, each variable a dimension of its own.

Up to ``DIMENSIONS`` variables, a vector is kept as all of its values; with more, as the places and values of those that
aren't 0. ``folded`` has variables share dimensions by signed hashing, for hash strings only. Values that are null, NaN or infinite
count as 0; of repeated (observation, variable) rows the one with the latest version counts (the greatest value among equals).
Observations without a value other than 0, or with a null name, have no vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 4096


#: Values of vectors filled at once; values of one observation, as a multiple of the variables, that are sent in one row.
VALUES, REPEATS = 4_000_000, 16


def _latest(key: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in order of their keys; of a repeated key the one with the latest version, among these the greatest value."""
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if same.any():
        among = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        some = order[among]
        known = ~np.isnan(x[some])
        some = some[np.lexsort([np.where(known, x[some], 0), known, t[some], key[some]])]
        order = np.concatenate([order[~among], some[np.concatenate([np.diff(key[some]) != 0, [True]])]])
        order = order[np.argsort(key[order], kind="stable")]
    return order


def dense(counts: DataFrame, obs: str = "obs", var: str = "var", value: str = "value", version: str | None = "load_id") -> tuple[DataFrame, int]:
    """((k, v), dimensions): v holds the values as float32 bytes; beyond ``DIMENSIONS``, int32 places and then float32 values."""
    c = lambda n: F.col(f"`{n}`")
    rows = counts.select(c(obs).cast("string").alias("k"), c(var).cast("string").alias("d"), c(value).cast("double").alias("x"), (c(version) if version else F.lit(0)).alias("t"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("d").isNotNull())
    distinct = rows.select("d").distinct()
    names = sorted(r[0] for r in distinct.limit(DIMENSIONS + 1).collect())
    spark, few = counts.sparkSession, len(names) <= DIMENSIONS
    size = len(names) if few else distinct.count()
    most = rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    if most > REPEATS * max(size, 100) or dict(rows.dtypes)["t"] not in ("tinyint", "smallint", "int", "bigint"):
        # too many repeats for one row, or versions that aren't whole numbers
        rows = rows.groupBy("k", "d").agg(F.max_by("x", F.struct("t", F.when(~F.isnan("x"), F.col("x")).alias("x"))).alias("x")).withColumn("t", F.lit(0))
    if few:
        table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "d string, i int")
        rows = rows.join(F.broadcast(table), "d")  # at most DIMENSIONS rows
    else:
        rows = rows.join(distinct.withColumn("i", F.row_number().over(Window.orderBy("d")) - 1), "d")
    # repeats are settled in ``fill``: lists hold no nulls, versions only travel where they differ
    t, x = F.coalesce(F.col("t").cast("long"), F.lit(-(2**63))), F.coalesce("x", F.lit(float("nan")))
    packed = rows.groupBy("k").agg(F.collect_list("i").alias("i"), F.collect_list(t).alias("t"), F.collect_list(x).alias("x"), F.min(t).alias("old"), F.max(t).alias("new"))
    packed = packed.select("k", "i", F.when(F.col("old") < F.col("new"), F.col("t")).alias("t"), "x")

    def fill(batches):
        step = max(16, VALUES // max(size, 1))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                i, x = (part.column(c).flatten().to_numpy() for c in ("i", "x"))
                length = part.column("i").value_lengths().to_numpy()
                row, t = np.repeat(np.arange(len(part), dtype=np.int64), length), np.zeros(len(i), np.int64)
                t[np.repeat(part.column("t").is_valid().to_numpy(zero_copy_only=False), length)] = part.column("t").flatten().to_numpy()
                order = _latest(row * size + i, t, x)
                order = order[(x[order] != 0) & np.isfinite(x[order])]
                with np.errstate(over="ignore"):
                    row, i, x = row[order], i[order], x[order].astype(np.float32)
                n = np.bincount(row, minlength=len(part))
                if few:
                    out = np.zeros((len(part), size), np.float32)
                    out[row, i] = x
                    v = [r.tobytes() for r in out[n > 0]]
                else:
                    # in order of their places, so that equal vectors have equal bytes
                    ends = np.cumsum(n)
                    v = [i[z - m : z].tobytes() + x[z - m : z].tobytes() for z, m in zip(ends, n) if m]
                yield pa.RecordBatch.from_arrays([part.column("k").filter(pa.array(n > 0)), pa.array(v, pa.binary())], names=["k", "v"])

    return packed.mapInArrow(fill, "k string, v binary"), size


def block(size: int) -> int:
    """Rows of that many values to hold at once."""
    return max(16, 4096 * DIMENSIONS // max(size, DIMENSIONS))


def sparse(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, places, values) of vectors kept as places and values."""
    n = np.array([len(v) // 8 for v in column], np.int64)
    at = [np.frombuffer(v, np.int32, len(v) // 8) for v in column]
    x = [np.frombuffer(v, np.float32, offset=len(v) // 2) for v in column]
    return np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.zeros(0, np.int32), *at]), np.concatenate([np.zeros(0, np.float32), *x])


def stack(column: pd.Series, size: int) -> np.ndarray:
    if size <= DIMENSIONS:
        return np.frombuffer(b"".join(column), np.float32).reshape(len(column), size)
    start, at, x = sparse(column)
    out = np.zeros((len(column), size), np.float32)
    out[np.repeat(np.arange(len(column)), np.diff(start)), at] = x
    return out


def folded(column: pd.Series, size: int) -> np.ndarray:
    """Vectors of at most ``DIMENSIONS`` dimensions, which variables share by signed hashing if there are more."""
    if size <= DIMENSIONS:
        return stack(column, size)
    start, at, x = sparse(column)
    h = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(column), DIMENSIONS), np.float32)
    sign = 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float32)
    np.add.at(out, (np.repeat(np.arange(len(column)), np.diff(start)), ((h >> np.uint64(44)) % np.uint64(DIMENSIONS)).astype(np.int64)), x * sign)
    return out


class Units:
    """Directions of vectors, for exact cosines among them."""

    def __init__(self, column: pd.Series, size: int):
        self.size, self.raw = size, stack(column, size) if size <= DIMENSIONS else None
        self.all = unit(self.raw) if size <= DIMENSIONS else None
        if self.all is None:
            self.start, self.at, x = sparse(column)
            self.raw = x
            row = np.repeat(np.arange(len(column)), np.diff(self.start))
            norm = np.sqrt(np.bincount(row, x.astype(np.float64) ** 2, len(column)))
            self.x = (x / np.maximum(norm, 1e-30)[row]).astype(np.float32)

    def _part(self, rows: np.ndarray, variables: np.ndarray) -> np.ndarray:
        """Rows at some variables, in order."""
        n = self.start[rows + 1] - self.start[rows]
        row = np.repeat(np.arange(len(rows)), n)
        s = np.repeat(self.start[rows], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at, x = self.at[s], self.x[s]
        to = np.minimum(np.searchsorted(variables, at), max(len(variables) - 1, 0))
        known = variables[to] == at if len(variables) else np.zeros(len(at), bool)
        out = np.zeros((len(rows), len(variables)), np.float32)
        out[row[known], to[known]] = x[known]
        return out

    def of(self, rows: np.ndarray, others) -> np.ndarray:
        """Cosines of rows with others: places, or a range (first, last + 1)."""
        if self.all is not None:
            return self.all[rows] @ (self.all[others[0] : others[1]] if isinstance(others, tuple) else self.all[others]).T
        others = np.arange(*others) if isinstance(others, tuple) else others
        variables = np.unique(np.concatenate([self.at[self.start[i] : self.start[i + 1]] for i in rows]))
        x, step = self._part(rows, variables), block(len(variables))
        return np.hstack([x @ self._part(others[k : k + step], variables).T for k in range(0, len(others), step)])


    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosines of each of ``a`` with the one of ``b`` beside it, in double precision."""
        out, step = np.zeros(len(a)), max(16, 2_000_000 // max(self.size, 1))
        for at in range(0, len(a), step):
            i, j = a[at : at + step], b[at : at + step]
            if self.all is not None:
                x, y = self.raw[i].astype(np.float64), self.raw[j].astype(np.float64)
                dot, xx, yy = (np.einsum("ij,ij->i", *z) for z in ((x, y), (x, x), (y, y)))
            else:
                (p, x), (q, y) = self._entries(i), self._entries(j)
                both, u, v = np.intersect1d(p, q, assume_unique=True, return_indices=True)
                dot, xx, yy = (np.bincount(z // self.size, w, len(i)) for z, w in ((both, x[u] * y[v]), (p, x * x), (q, y * y)))
            out[at : at + step] = dot / np.sqrt(np.maximum(xx * yy, 1e-300))
        return out

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the row x dimensions + place, value) of rows of places and values."""
        n = self.start[rows + 1] - self.start[rows]
        row = np.repeat(np.arange(len(rows)), n)
        s = np.repeat(self.start[rows], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row * self.size + self.at[s], self.raw[s].astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
