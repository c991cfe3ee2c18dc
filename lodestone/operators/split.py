"""Mixed observations split into one virtual observation for each category."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.transport import fit_rows
from lodestone.operators.annotate import profile_matrix
from lodestone.operators.packed import Rows, kind, packed, per_block


def split_exact(x: DataFrame, weights: DataFrame, profiles: DataFrame, min_counts: float | None = None, seed: int | None = 0, delta: float = 1e-5) -> DataFrame:
    """(obs, category, var, value) with the given profiles in mind: values of an observation and variable add up to the count.

    For each observation profiles are fitted to its counts (by variable) and its weights times its total (by category). With a
    ``seed`` values are whole numbers: floors, and the remaining reads go to the categories drawn by their fractions. Weights
    worth fewer than ``min_counts`` reads are dropped, but for the greatest."""
    m, var, cat = profile_matrix(profiles)
    m = m + 1e-3 / len(var)
    m = m / m.sum(0)
    known = weights.filter("weight > 0 and category is not null").filter(F.col("category").isin(cat)) if len(cat) <= 1000 else weights.filter("weight > 0")
    w = known.groupBy("obs").agg(F.collect_list("category").alias("c"), F.collect_list("weight").alias("w"))
    rows = packed(x.filter("value > 0"), var).join(w, "obs")
    names = pa.array(cat, pa.string())

    def run(r: Rows) -> pa.RecordBatch:
        n = len(r.names)
        size = r.batch.column("c").value_lengths().to_numpy()
        place = pc.index_in(r.batch.column("c").flatten(), names).to_numpy(zero_copy_only=False)
        row, value = np.repeat(np.arange(n), size), r.batch.column("w").flatten().to_numpy()
        fine = ~np.isnan(place.astype(float))
        share = np.zeros((n, len(cat)))
        np.add.at(share, (row[fine], place[fine].astype(int)), value[fine])
        i, k, j, values = exact_block(m, r.block, share, r.names, min_counts, seed, delta)
        return pa.RecordBatch.from_arrays([r.names.take(pa.array(i)), names.take(pa.array(k)), pa.array(var, pa.string()).take(pa.array(j)), pa.array(values)], names=["obs", "category", "var", "value"])

    return per_block(rows, len(var), run, f"obs {kind(x)}, category string, var string, value double")


def exact_block(m: np.ndarray, counts: np.ndarray, share: np.ndarray, names: pa.Array, min_counts: float | None, seed: int | None, delta: float = 1e-5) -> tuple[np.ndarray, ...]:
    """``split_exact`` of a dense block with the weights ``share``: (row, category, variable, value) of all positive values."""
    n, total = len(names), counts.sum(1, keepdims=True)
    share = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
    if min_counts is not None:
        good = share * total >= min_counts
        good[np.arange(n), share.argmax(1)] = True
        share = share * good
        share = share / np.maximum(share.sum(1, keepdims=True), 1e-300)
    a, b = fit_rows(m, counts, share * total, delta)
    out = []
    for at in range(0, n, max(1, 2_000_000 // max(1, len(m)))):
        part = slice(at, at + max(1, 2_000_000 // max(1, len(m))))
        i, j = np.nonzero(counts[part])
        i = i + at
        values = a[i, j][:, None] * m[j] * b[i]
        # the rows are exact whatever the fit
        sums = values.sum(1, keepdims=True)
        ways = share[i] > 0
        values = np.where(sums > 0, values / np.where(sums > 0, sums, 1), ways / np.maximum(ways.sum(1, keepdims=True), 1)) * counts[i, j][:, None]
        if seed is not None:
            values = _whole(values, counts[i, j], i, names, seed)
        e, k = np.nonzero(values > 0)
        out.append((i[e], k, j[e], values[e, k]))
    i, k, j, values = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 3 + (np.zeros(0),)
    return i, k, j, values


def _whole(values: np.ndarray, counts: np.ndarray, row: np.ndarray, names: pa.Array, seed: int) -> np.ndarray:
    """Floors of the values, and the remaining reads drawn by the fractions, from a generator for each observation; observations
    whose counts aren't whole stay as they are."""
    out = values.copy()
    edge = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    for s, t in zip(edge[:-1], edge[1:]):
        n = counts[s:t]
        if not np.allclose(n, np.round(n)):
            continue
        whole = np.floor(values[s:t] + 1e-9)
        rest = np.round(n - whole.sum(1)).astype(int)
        f = np.maximum(values[s:t] - whole, 0)
        f = np.where(f.sum(1, keepdims=True) > 0, f, values[s:t] > 0)
        rng = np.random.default_rng([seed, *str(names[int(row[s])].as_py()).encode()])
        out[s:t] = whole + rng.multinomial(np.maximum(rest, 0), f / f.sum(1, keepdims=True))
    return out


def reconstruct(x: DataFrame, weights: DataFrame, profiles: DataFrame, mapping: DataFrame | None = None, min_counts: float | None = None, bulk: bool = False) -> DataFrame:
    """(obs, category, var, value): the counts that weights and profiles imply, in place of the measured ones; by mapped
    category (mapping: sub, category), or all together as category 'bulk'."""
    total = x.groupBy("obs").agg(F.sum("value").alias("n"))
    w = weights.join(total, "obs").withColumn("reads", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("obs"))) * F.col("n"))
    parts = w.join(profiles, "category")
    if bulk:
        parts = parts.withColumn("category", F.lit("bulk"))
    elif mapping is not None:
        parts = parts.withColumnRenamed("category", "sub").join(F.broadcast(mapping), "sub")  # one row a category
    out = parts.groupBy("obs", "category", "var").agg(F.sum(F.col("reads") * F.col("p")).alias("value"))
    return out if min_counts is None else at_least(out, min_counts)


def at_least(split: DataFrame, min_counts: float) -> DataFrame:
    """Virtual observations with enough counts."""
    good = split.groupBy("obs", "category").agg(F.sum("value").alias("_n")).filter(F.col("_n") >= min_counts).select("obs", "category")
    return split.join(good, ["obs", "category"], "left_semi")


def split_observations(x: DataFrame, weights: DataFrame, profiles: DataFrame, mode: str = "exact", mapping: DataFrame | None = None, min_counts: float | None = None, seed: int | None = 0, obs: DataFrame | None = None) -> DataFrame:
    """Modes 'exact', 'denoise' and 'bulk'; ``obs`` columns are carried to the virtual observations."""
    if mode == "exact":
        out = split_exact(x, weights, profiles, min_counts, seed)
        if mapping is not None:
            out = out.withColumnRenamed("category", "sub").join(F.broadcast(mapping), "sub").groupBy("obs", "category", "var").agg(F.sum("value").alias("value"))  # one row a category
        if min_counts is not None:
            out = at_least(out, min_counts)
    else:
        out = reconstruct(x, weights, profiles, mapping, min_counts, mode == "bulk")
    return out.join(obs, "obs", "left") if obs is not None else out


def hand_out(rows: DataFrame, counts: DataFrame, group: str, order: str) -> DataFrame:
    """Concrete rows of a group get the categories of annotated counts (group, category, n) in order: the first n rows the
    first category, and so on. Rows beyond the counts get null."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(order)))
    run = F.sum("n").over(w.orderBy("category").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = counts.filter("n > 0").withColumn("_to", run).withColumn("_from", run - F.col("n")).groupBy(group).agg(F.collect_list(F.struct("_from", "_to", "category")).alias("_s"))
    hit = F.filter("_s", lambda s: (s["_from"] < F.col("_k")) & (F.col("_k") <= s["_to"]))
    return r.join(spans, group, "left").withColumn("category", F.get(hit, F.lit(0))["category"]).drop("_k", "_s")
