"""Matrix rows packed into places and values, for block products in Arrow batches.

Variables become integer places by a join, so that a batch turns into a dense block by array operations alone. Only one
side of a product travels to the workers whole, and only up to ``ENTRIES`` of its entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most entries of a matrix that is sent to the workers, and most variables whose numbers are broadcast.
ENTRIES, NAMES = 50_000_000, 1_000_000
#: Entries of a dense block.
CELLS = 4_000_000
#: Most entries of a matrix of variables by variables.
SQUARE = 4096
#: Kinds of gathered values by their bytes.
WIDTHS = {1: "u1", 2: "u2", 8: "f8"}


def small(df: DataFrame, row: str, column: str, value: str, name: str = "matrix", rows: list[str] | None = None) -> tuple[np.ndarray, list[str], list[str]]:
    """(matrix, rows, columns) of a long matrix of checked size; names in order."""
    m = fetch(df, row, column, value)
    if m is None:
        raise ValueError(f"the {name} has too many entries: at most {ENTRIES} are sent to workers")
    return m


def fetch(df: DataFrame, row: str, column: str, value: str) -> tuple[np.ndarray, list[str], list[str]] | None:
    """As ``small``; None if the matrix, its zeros included, has more than ``ENTRIES`` entries."""
    n, r, c = df.agg(F.count("*"), F.count_distinct(row), F.count_distinct(column)).first()
    if max(n, r * c) > ENTRIES:
        return None
    p = df.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v")).filter("r is not null and c is not null and v is not null").toPandas()
    rows, columns = sorted(set(p["r"])), sorted(set(p["c"]))
    m = np.zeros((len(rows), len(columns)))
    np.add.at(m, (pd.Index(rows).get_indexer(p["r"]), pd.Index(columns).get_indexer(p["c"])), p["v"].to_numpy())
    return m, rows, columns


def packed(x: DataFrame, var: list[str]) -> DataFrame:
    """(obs, s): the stored entries of each row as (place in ``var``, value); -1 for other variables."""
    table = x.sparkSession.createDataFrame(pd.DataFrame({"var": pd.Series(var, dtype=object), "_at": np.arange(len(var), dtype=np.int32)}), "var string, _at int")
    table = F.broadcast(table) if len(var) <= NAMES else table.hint("merge")
    at = F.coalesce("_at", F.lit(-1)).alias("at")
    return x.filter("value is not null").join(table, "var", "left").groupBy("obs").agg(F.collect_list(F.struct(at, F.col("value").cast("double").alias("x"))).alias("s"))


def gathered(x: DataFrame, var: list[str]) -> DataFrame:
    """(obs, parts): the entries of each row in parts of bytes, packed batch by batch before they are shuffled: places in ``var`` as the
    smallest integers that hold them, and values, in one or two bytes each where all of a batch are whole and fit. Other variables,
    and null rows or values, are left out."""
    place, names = np.dtype("u1" if len(var) <= 1 << 8 else "u2" if len(var) <= 1 << 16 else "u4"), pa.array(var, pa.string())

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pc.index_in(batch.column("var"), names)
            keep = pc.and_(pc.and_(pc.is_valid(at), pc.is_valid(batch.column("value"))), pc.is_valid(batch.column("obs")))
            batch, at = batch.filter(keep), at.filter(keep).to_numpy(zero_copy_only=False)
            obs, value = batch.column("obs").dictionary_encode(), batch.column("value").to_numpy(zero_copy_only=False)
            code = obs.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            whole = ((value >= 0) & (value < 1 << 16) & (value == np.floor(value))).all()
            width = 8 if not whole else 2 if (value >= 1 << 8).any() else 1
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(obs.dictionary)))])
            columns = []
            for v in (at[order].astype(place), value[order].astype(WIDTHS[width])):
                columns.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v.tobytes())]))
            yield pa.RecordBatch.from_arrays([obs.dictionary, *columns], names=["obs", "a", "x"])

    parts = x.select("obs", "var", F.col("value").cast("double").alias("value")).mapInArrow(bundle, f"obs {kind(x)}, a binary, x binary")
    return parts.groupBy("obs").agg(F.collect_list(F.struct("a", "x")).alias("parts"))


@dataclass
class Rows:
    """Some rows: their names, the dense block over the known variables, and all stored entries (row, value) of them."""

    names: pa.Array
    block: np.ndarray
    row: np.ndarray
    x: np.ndarray
    batch: pa.RecordBatch

    def sums(self, f: Callable[[np.ndarray], np.ndarray] = lambda v: v) -> np.ndarray:
        return np.bincount(self.row, f(self.x), len(self.names))


def dense(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[Rows]:
    step = max(16, CELLS // max(size, 1))
    for batch in batches:
        lists = batch.column("s")
        at, x = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        for a in range(0, batch.num_rows, step):
            b = min(batch.num_rows, a + step)
            e = slice(ends[a], ends[b])
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            place, value = at[e].astype(np.int64), x[e]
            k = place >= 0
            block = np.bincount(row[k] * size + place[k], value[k], (b - a) * size).reshape(b - a, size)
            part = batch.slice(a, b - a)
            yield Rows(part.column("obs"), block, row, value, part)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after the other, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "u1")
    return (data[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)) if len(ends) else (data[:0], np.zeros(0, np.int64))


def spread(batches: Iterable[pa.RecordBatch], size: int, repeats: str = "sum") -> Iterator[Rows]:
    """As ``dense``, of gathered rows; of repeated entries the sum or the greatest (``max``) counts."""
    place, step = 1 if size <= 1 << 8 else 2 if size <= 1 << 16 else 4, max(16, CELLS // max(size, 1))
    for whole in batches:
        for a in range(0, whole.num_rows, step):
            batch = whole.slice(a, step)
            lists = batch.column("parts")
            (a_at, a_size), (x_at, x_size) = (_bytes(c) for c in lists.flatten().flatten())
            n, owner = a_size // place, np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, row, value = a_at.view(f"u{place}"), np.repeat(owner, n), np.zeros(n.sum())
            for width, what in WIDTHS.items():
                there = x_size == n * width
                value[np.repeat(there, n)] = x_at[np.repeat(there, x_size)].view(what)
            cell = row.astype(np.int64) * size + at.astype(np.int64)
            if repeats == "max":
                order = np.lexsort([value, cell])
                last = np.diff(cell[order], append=-1) != 0
                cell, value = cell[order[last]], value[order[last]]
            block = np.bincount(cell, value, batch.num_rows * size).reshape(batch.num_rows, size)
            yield Rows(batch.column("obs"), block, cell // max(size, 1), value, batch)


def per_block(rows: DataFrame, size: int, run: Callable[[Rows], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` on dense blocks of packed rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in dense(batches, size):
            yield run(r)

    return rows.mapInArrow(each, schema)


def kind(df: DataFrame, column: str = "obs") -> str:
    return df.schema[column].dataType.simpleString()


def long(names: pa.Array, columns: list[str], values: np.ndarray, keep: np.ndarray | None, labels: tuple[str, str, str]) -> pa.RecordBatch:
    """A block of values as (row, column, value) rows; only those in ``keep`` if given."""
    k = np.arange(values.size) if keep is None else np.flatnonzero(keep)
    n = max(values.shape[1], 1)
    return pa.RecordBatch.from_arrays([names.take(pa.array(k // n)), pa.array(columns, pa.string()).take(pa.array(k % n)), pa.array(values.ravel()[k], pa.float64())], names=list(labels))


def total(parts: DataFrame, n: int, width: int) -> np.ndarray:
    """The sum of matrices (n by width) that tasks emit as ``chunks``, added up in parallel."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "m": [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]})

    out = np.zeros((n, width))
    for r in parts.groupBy("c").applyInPandas(add, "c int, m binary").toLocalIterator():
        m = np.frombuffer(r["m"]).reshape(-1, width)
        out[r["c"] * 256 : r["c"] * 256 + len(m)] = m
    return out


def chunks(m: np.ndarray) -> pa.RecordBatch:
    at = range(0, len(m), 256)
    return pa.RecordBatch.from_arrays([pa.array([a // 256 for a in at], pa.int32()), pa.array([np.ascontiguousarray(m[a : a + 256]).tobytes() for a in at], pa.binary())], names=["c", "m"])


def summed(rows: DataFrame, size: int, f: Callable[[Rows], np.ndarray], n: int, width: int) -> np.ndarray:
    """The sum over all blocks of ``f``, a matrix n by width: one a task, added up by pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((n, width))
        for r in dense(batches, size):
            s += f(r)
        yield chunks(s)

    return total(rows.mapInArrow(run, "c int, m binary"), n, width)


def axes(rows: DataFrame, size: int, k: int, f: Callable[[Rows], np.ndarray], center: bool = True, passes: int = 6, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, variances, mean): the k first principal axes of the blocks that ``f`` makes, signs so that the greatest entry is positive.

    Up to ``SQUARE`` variables from their covariances; with more by subspace iteration, in ``passes`` passes over the rows."""
    first = summed(rows, size, lambda r: np.concatenate([f(r).sum(0), [len(r.names)]])[:, None], size + 1, 1).ravel()
    n = max(first[-1], 1.0)
    mean = first[:-1] / n if center else np.zeros(size)
    k = min(k, size)
    if size <= SQUARE:
        values, vectors = np.linalg.eigh(summed(rows, size, lambda r: (lambda b: b.T @ b)(f(r)), size, size) / n - np.outer(mean, mean))
        order = np.argsort(-values)[:k]
        values, vectors = values[order], vectors[:, order]
    else:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, k + 10))))[0]
        for _ in range(passes):
            y = summed(rows, size, lambda r, q=q: (lambda b: b.T @ (b @ q))(f(r)), size, q.shape[1]) / n - np.outer(mean, mean @ q)
            inner = q.T @ y
            q = np.linalg.qr(y)[0]
        y = summed(rows, size, lambda r: (lambda b: b.T @ (b @ q))(f(r)), size, q.shape[1]) / n - np.outer(mean, mean @ q)
        inner = q.T @ y
        values, small_vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:k]
        values, vectors = values[order], q @ small_vectors[:, order]
    if vectors.size:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return vectors, values, mean
