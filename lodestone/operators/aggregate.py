"""Sums, profiles, contributions and merges over long matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import packed
from lodestone.operators.elementwise import normalise
from lodestone.runtime import cut


def get_sum(x: DataFrame, axis: str = "obs") -> DataFrame:
    return x.groupBy(axis).agg(F.sum("value").alias("total"))


def reference_profiles(x: DataFrame, labels: DataFrame, target: float | None = None, trafo: str | None = None, normalized: bool = True) -> DataFrame:
    """(var, category, p): the mean of every variable over the observations of a category (absent entries are 0), summing to
    1 by category. Optionally observations are scaled to ``target`` first, and means taken of log1p or sqrt and turned back."""
    if target is not None:
        x = normalise(x, "obs", "value", target)
    v = {None: F.col("value"), "log1p": F.log1p("value"), "sqrt": F.sqrt("value")}[trafo]
    labels = labels.filter("category is not null").select("obs", "category")
    n = labels.groupBy("category").agg(F.count("*").alias("n"))
    sums = x.withColumn("v", v).join(labels, "obs").groupBy("category", "var").agg(F.sum("v").alias("s"))
    p = sums.join(F.broadcast(n), "category").withColumn("p", F.col("s") / F.col("n"))  # one row a category
    if trafo:
        p = p.withColumn("p", F.expm1("p") if trafo == "log1p" else F.col("p") * F.col("p"))
    p = p.select("var", "category", "p")
    return normalise(p, "category", "p") if normalized else p


def soft_profiles(x: DataFrame, weights: DataFrame) -> DataFrame:
    """(var, category, p) from soft labels: reads split by weight, summing to 1 by category."""
    sums = x.join(weights, "obs").groupBy("category", "var").agg(F.sum(F.col("value") * F.col("weight")).alias("p"))
    return normalise(sums, "category", "p").select("var", "category", "p")


def refine_reference(x: DataFrame, weights: DataFrame, profiles: DataFrame, regularization: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """One expectation-maximisation step of the read model p(obs, var, category) = p(var | category) p(category | obs) n: new (profiles, weights).
    ``regularization`` is added to the profiles as a share of the uniform profile.

    Entries are shuffled packed by observation, and shares are block products in tasks, as long as the profiles can be sent
    there; beyond ``packed.ENTRIES`` of them they are joins."""
    names = x.select("var").filter("var is not null").distinct()
    cats = profiles.select("category").filter("category is not null").distinct()
    if names.count() * cats.count() > packed.ENTRIES:
        return _refined_by_joins(x, weights, profiles, regularization)
    var, cat = (sorted(r[0] for r in d.collect()) for d in (names, cats))
    soft = weights.filter("category is not null and weight is not null").groupBy("obs").agg(F.collect_list("category").alias("c"), F.collect_list("weight").alias("w"))
    rows = cut(packed.gathered(x, var).join(soft, "obs"))
    p = profiles.filter("p is not null").select("var", "category", "p").toPandas()  # of checked size
    m = np.zeros((len(var), len(cat)))
    i, j = pd.Index(var).get_indexer(p["var"]), pd.Index(cat).get_indexer(p["category"])
    np.add.at(m, (i[i >= 0], j[i >= 0]), p["p"].to_numpy(float)[i >= 0])
    return refined(rows, m, var, cat, regularization)


def refined(rows: DataFrame, m: np.ndarray, var: list[str], cat: list[str], regularization: float = 1e-3, repeats: str = "sum") -> tuple[DataFrame, DataFrame]:
    """``refine_reference`` of gathered rows with lists of their categories ``c`` and weights ``w``, and profiles ``m`` (var by category)."""
    m = m + regularization / max(len(var), 1)
    m = m / m.sum(0)
    known, size = pa.array(cat, pa.string()), len(cat)

    def shares(r: packed.Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weights of a block and where there are any, and its reads over what the model expects."""
        lists = r.batch.column("c")
        row = np.repeat(np.arange(len(r.names)), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = pc.index_in(lists.flatten(), known).to_numpy(zero_copy_only=False)
        ok = ~np.isnan(at.astype(float))
        cell = row[ok] * size + at[ok].astype(np.int64)
        w = np.bincount(cell, r.batch.column("w").flatten().to_numpy(zero_copy_only=False)[ok], len(r.names) * size).reshape(-1, size)
        there = np.bincount(cell, minlength=len(r.names) * size).reshape(-1, size) > 0
        z = w @ m.T
        return w, there, np.divide(r.block, z, out=np.zeros_like(z), where=z != 0)

    def reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((len(var), 3 * size))
        for r in packed.spread(batches, len(var), repeats):
            w, there, ratio = shares(r)
            s[:, :size] += m * (ratio.T @ w)
            for k, entries in ((1, r.block > 0), (2, ratio > 0)):
                s[:, k * size : (k + 1) * size] += entries.T.astype(np.float32) @ there.astype(np.float32)
        yield packed.chunks(s)

    def reweighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in packed.spread(batches, len(var), repeats):
            w, there, ratio = shares(r)
            yield packed.long(r.names, cat, w * (ratio @ m), there.ravel(), ("obs", "category", "weight"))

    sums = packed.total(rows.mapInArrow(reads, "c int, m binary"), len(var), 3 * size)
    i, j = np.nonzero(sums[:, size : 2 * size] > 0)
    p = pd.DataFrame({"var": np.array(var, object)[i], "category": np.array(cat, object)[j], "p": sums[i, j], "some": sums[i, j + 2 * size] > 0})
    p = rows.sparkSession.createDataFrame(p, "var string, category string, p double, some boolean").select("var", "category", F.when(F.col("some"), F.col("p")).alias("p"))  # null where nothing was expected
    new_p = normalise(p, "category", "p")
    return new_p, normalise(rows.mapInArrow(reweighed, f"obs {packed.kind(rows)}, category string, weight double"), "obs", "weight")


def refine_labelled(x: DataFrame, labels: DataFrame, own: float, other: float, regularization: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """``refine_reference`` of the labelled observations' own profiles, with the weight ``own`` for the category of the label and
    ``other`` for every other one. Of repeated entries the greatest counts; entries are shuffled once."""
    var = sorted(r[0] for r in x.select("var").filter("var is not null").distinct().limit(packed.NAMES + 1).collect())
    rows = cut(packed.gathered(x, var).join(labels.filter("category is not null").select("obs", "category"), "obs")) if len(var) <= packed.NAMES else None
    cat = sorted(r[0] for r in (labels.filter("category is not null") if rows is None else rows).select("category").distinct().limit(packed.ENTRIES + 1).collect())
    if rows is None or len(var) * len(cat) > packed.ENTRIES:
        single = x.groupBy("obs", "var").agg(F.max("value").alias("value"))
        every = labels.select(F.col("category").alias("c")).filter("c is not null").distinct()
        soft = labels.filter("category is not null").crossJoin(every).select("obs", F.col("c").alias("category"), F.when(F.col("c") == F.col("category"), own).otherwise(other).alias("weight"))
        return _refined_by_joins(single, soft, reference_profiles(single, labels), regularization)
    known = pa.array(cat, pa.string())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((len(var), len(cat)))
        for r in packed.spread(batches, len(var), "max"):
            to = pc.index_in(r.batch.column("category"), known).to_numpy(zero_copy_only=False)
            for c in np.unique(to):
                s[:, c] += r.block[to == c].sum(0)
        yield packed.chunks(s)

    m = packed.total(rows.mapInArrow(sums, "c int, m binary"), len(var), len(cat))
    c = F.array(*[F.lit(v) for v in cat]) if cat else F.array().cast("array<string>")
    soft = rows.withColumn("c", c).withColumn("w", F.transform("c", lambda v: F.when(v == F.col("category"), own).otherwise(other)))
    return refined(soft, np.divide(m, m.sum(0), out=np.zeros_like(m), where=m.sum(0) != 0), var, cat, regularization, "max")


def _refined_by_joins(x: DataFrame, weights: DataFrame, profiles: DataFrame, regularization: float) -> tuple[DataFrame, DataFrame]:
    g = x.select("var").distinct().count()
    cats = profiles.select("category").distinct()
    grid = x.select("var").distinct().crossJoin(F.broadcast(cats)).join(profiles, ["var", "category"], "left").fillna(0.0, ["p"])
    p = normalise(grid.withColumn("p", F.col("p") + regularization / g), "category", "p")
    share = x.join(weights, "obs").join(p, ["var", "category"]).withColumn("q", F.col("weight") * F.col("p"))
    total = share.groupBy("obs", "var").agg(F.sum("q").alias("z"))
    reads = share.join(total, ["obs", "var"]).withColumn("r", F.col("value") * F.try_divide(F.col("q"), F.col("z")))
    new_p = normalise(reads.groupBy("var", "category").agg(F.sum("r").alias("p")), "category", "p")
    new_w = normalise(reads.groupBy("obs", "category").agg(F.sum("r").alias("weight")), "obs", "weight")
    return new_p, new_w


def contributions(
    values: DataFrame,
    groups: DataFrame,
    reduction: str | Callable | None = "sum",
    normalization: str | Callable | None = None,
    restrict_groups: list | None = None,
    restrict_values: list | None = None,
    fillna: float | None = None,
    min_obs: int = 0,
    positions: DataFrame | None = None,
    position_split: int | tuple[int, ...] | None = None,
    reads: DataFrame | None = None,
    zeros: str | None = None,
) -> DataFrame:
    """(group, sample, value_key, contribution).

    values(obs, category, weight) are soft or hard labels, numbers or counts; groups(obs, group[, sample]). Per group and
    sample the weights are reduced (sum, mean, median, or a function from a column, zeros included, to an aggregate; None keeps
    observations) over a complete grid, then normalised by row: sum (shares), percent, gmean (by the geometric mean), clr
    (log of that), the name of a value (by its contribution), or a function of (column, window of the row).

    ``position_split`` parts, along x and then y of positions(obs, x, y), make samples of each sample. ``reads`` (obs, total)
    multiplies the weights. ``zeros`` says what the geometric mean does with them: None, the shares are null; 'counts', 1 is added
    to everything; 'small', they become a thousandth of the least positive value; 'auto', one or the other by whether all
    contributions are whole."""
    has_sample = "sample" in groups.columns
    g = groups.select("obs", F.col("group").cast("string").alias("group"), (F.col("sample").cast("string") if has_sample else F.lit("")).alias("sample")).filter("group is not null and sample is not null")
    if position_split:
        from lodestone.operators.spatial import split_spatial_samples

        split = (position_split,) * 2 if isinstance(position_split, int) else tuple(position_split)
        placed = g.join(positions.select("obs", "x", "y").filter("x is not null and y is not null and not isnan(x) and not isnan(y)"), "obs")
        parts = split_spatial_samples(placed, [(axis, n) for axis, n in zip("xy", split) if n > 1])
        g = parts.filter("label is not null").select("obs", "group", F.col("label").alias("sample"))
    if restrict_groups is not None:
        g = g.filter(F.col("group").isin(restrict_groups))
    if min_obs:
        enough = g.groupBy("sample").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_obs)
        g = g.join(enough.select("sample"), "sample", "left_semi")
    v = values.select("obs", "category", F.col("weight").cast("double").alias("weight"))
    if restrict_values is not None:
        v = v.filter(F.col("category").isin(restrict_values))
    if fillna is not None:
        v = v.fillna(fillna, ["weight"])
    if reads is not None:
        v = v.join(reads.select("obs", "total"), "obs").select("obs", "category", (F.col("weight") * F.col("total")).alias("weight"))
    joined = v.join(g, "obs")
    cats = v.select("category").distinct()
    rows = g.groupBy("group", "sample").agg(F.count("*").alias("n"))
    if reduction is None:
        rows = g.select("group", "sample", "obs")
        sums = joined.groupBy("group", "sample", "obs", "category").agg(F.sum("weight").alias("c"))
    elif reduction == "median" or callable(reduction):
        # absent entries are zeros
        full = g.crossJoin(F.broadcast(cats)).join(v, ["obs", "category"], "left").fillna(0.0, ["weight"])
        reduced = reduction(F.col("weight")) if callable(reduction) else F.percentile("weight", 0.5)
        sums = full.groupBy("group", "sample", "category").agg(reduced.alias("c"))
    else:
        sums = joined.groupBy("group", "sample", "category").agg(F.sum("weight").alias("c"))
    keys = [c for c in rows.columns if c != "n"]
    grid = rows.crossJoin(F.broadcast(cats)).join(sums, [*keys, "category"], "left").fillna(0.0, ["c"])  # categories of labels
    if reduction == "mean":
        grid = grid.withColumn("c", F.col("c") / F.col("n"))
    w = Window.partitionBy(*keys)
    c = F.col("c")
    if normalization in ("gmean", "clr") and zeros:
        if zeros == "auto":
            zeros = "counts" if grid.agg(F.bool_and((c >= 0) & (c == F.rint(c)))).first()[0] else "small"
        if zeros == "small":
            least = grid.filter("c > 0").agg(F.min("c")).first()[0] or 1.0
            grid = grid.withColumn("c", F.when(c == 0, F.lit(1e-3 * least)).otherwise(c))
        else:
            grid = grid.withColumn("c", c + 1)
    if normalization in ("sum", "percent"):
        c = F.try_divide(c, F.sum("c").over(w)) * (100 if normalization == "percent" else 1)
    elif normalization in ("gmean", "clr"):
        # zeros make the geometric mean 0: the shares are null then
        logs = F.avg(F.when(F.col("c") > 0, F.log("c"))).over(w)
        all_there = F.min("c").over(w) > 0
        c = F.when(all_there, F.log("c") - logs if normalization == "clr" else F.col("c") / F.exp(logs))
    elif callable(normalization):
        c = normalization(c, w)
    elif normalization is not None:
        c = F.try_divide(c, F.max(F.when(F.col("category") == normalization, F.col("c"))).over(w))
    return grid.select(*keys, F.col("category").alias("value_key"), c.alias("contribution"))


def compositions(values: DataFrame, groups: DataFrame, **kw) -> DataFrame:
    return contributions(values, groups, "sum", "sum", **kw)


def merge_observations(x: DataFrame, index: DataFrame, min_counts: float | None = None, mean_keys: list[str] = (), first_keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Virtual observations merged by (index, category): index(obs, index, category, order, ...). Counts add up; of other
    columns the first row in ``order`` counts, ``mean_keys`` are averaged; merged rows below ``min_counts`` (or 0) drop out."""
    merged = x.join(index.select("obs", "index", "category"), "obs").groupBy("index", "category", "var").agg(F.sum("value").alias("value"))
    total = merged.groupBy("index", "category").agg(F.sum("value").alias("t"))
    kept = total.filter(F.col("t") >= min_counts) if min_counts is not None else total.filter("t > 0")
    about = index.groupBy("index", "category").agg(F.count("*").alias("n"), *[F.avg(k).alias(k) for k in mean_keys], *[F.min_by(k, "order").alias(k) for k in first_keys])
    return merged.join(kept.select("index", "category"), ["index", "category"], "left_semi"), about.join(kept.select("index", "category"), ["index", "category"], "left_semi")


def combine_layers(x: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Layered counts (obs, var, layer, value) summed to coarse layers; layers without a target drop out."""
    table = [(f, c) for c, fs in mapping.items() for f in fs]
    m = x.sparkSession.createDataFrame(table, "layer string, coarse string")
    return x.join(F.broadcast(m), "layer").groupBy("obs", "var", F.col("coarse").alias("layer")).agg(F.sum("value").alias("value"))


def merge_layers(x: DataFrame, layers: list[str] | None = None, min_reads: float | None = None) -> DataFrame:
    """Layered counts (obs, var, layer, value) as virtual observations (obs, layer): those of some layers, with at least
    ``min_reads`` (or any)."""
    x = x if layers is None else x.filter(F.col("layer").isin(layers))
    kept = x.groupBy("obs", "layer").agg(F.sum("value").alias("t")).filter("t > 0" if min_reads is None else F.col("t") >= min_reads).select("obs", "layer")
    return x.join(kept, ["obs", "layer"], "left_semi")


def pick_types(weights: DataFrame, types: list[str], column: str = "category") -> DataFrame:
    """Rows of some types, with their place in the given order in ``order``."""
    order = F.array_position(F.array(*[F.lit(t) for t in types]).cast("array<string>"), F.col(column))
    return weights.withColumn("order", order.cast("int")).filter("order > 0")


def widen(x: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One column for each of ``names``, sums of the value, null where there is none."""
    return x.groupBy(row).pivot(column, names).agg(F.sum(value))


def lengthen(wide: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value) of a wide table; nulls drop out."""
    return wide.unpivot(row, [c for c in wide.columns if c != row], column, value).filter(F.col(value).isNotNull())


def category_priors(x: DataFrame, weights: DataFrame) -> DataFrame:
    """(category, prior): each category's share of the reads, by soft labels that sum to 1."""
    reads = get_sum(x).join(normalise(weights, "obs", "weight"), "obs").groupBy("category").agg(F.sum(F.col("total") * F.col("weight")).alias("prior"))
    return reads.crossJoin(F.broadcast(reads.agg(F.sum("prior").alias("_t")))).select("category", F.try_divide("prior", "_t").alias("prior"))


def cell_size(x: DataFrame, weights: DataFrame) -> DataFrame:
    """(category, size): mean reads of an observation, weighted by soft labels."""
    return get_sum(x).join(weights, "obs").groupBy("category").agg(F.try_divide(F.sum(F.col("total") * F.col("weight")), F.sum("weight")).alias("size"))


def frame_to_counts(df: DataFrame, obs: str, var: str, count: str | None = None, compositional: list[str] = (), mean: list[str] = ()) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Long rows to (counts, {key: soft labels}, means): sums (or numbers) of rows by obs and var, shares of each
    compositional column's values by obs, and means by obs."""
    n = F.col(count).cast("double") if count else F.lit(1.0)
    rows = df.filter(F.col(obs).isNotNull() & F.col(var).isNotNull()).withColumn("_n", n).withColumn("obs", F.col(obs).cast("string"))
    counts = rows.groupBy("obs", F.col(var).cast("string").alias("var")).agg(F.sum("_n").alias("value"))
    soft = {k: normalise(rows.filter(F.col(k).isNotNull()).groupBy("obs", F.col(k).cast("string").alias("category")).agg(F.sum("_n").alias("weight")), "obs", "weight") for k in compositional}
    return counts, soft, rows.groupBy("obs").agg(F.count("*").alias("rows"), *[F.avg(k).alias(k) for k in mean])


def counts_to_frame(x: DataFrame, obs: DataFrame | None = None, var: DataFrame | None = None) -> DataFrame:
    """Non-zero entries as rows (obs, var, X) with columns of obs and var looked up."""
    out = x.filter("value <> 0").withColumnRenamed("value", "X")
    if obs is not None:
        out = out.join(obs, "obs", "left")
    return out.join(var, "var", "left") if var is not None else out


def annotation_histogram(weights: DataFrame, coordinate: DataFrame, delta: float) -> DataFrame:
    """(bin, category, mean): mean soft label by bin of a coordinate (obs, d)."""
    binned = coordinate.filter("d is not null").withColumn("bin", F.floor(F.col("d") / delta).cast("long"))
    n = binned.groupBy("bin").agg(F.count("*").alias("n"))
    s = weights.join(binned, "obs").groupBy("bin", "category").agg(F.sum("weight").alias("s"))
    return s.join(n, "bin").select("bin", "category", (F.col("s") / F.col("n")).alias("mean"))


def dot_table(x: DataFrame, labels: DataFrame) -> DataFrame:
    """(var, category, mean_log, fraction): mean log1p (zeros included) and share of observations with counts."""
    n = labels.filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    s = x.filter("value > 0").join(labels, "obs").filter("category is not null").groupBy("category", "var").agg(F.sum(F.log1p("value")).alias("s"), F.count("*").alias("k"))
    return s.join(F.broadcast(n), "category").select("var", "category", (F.col("s") / F.col("n")).alias("mean_log"), (F.col("k") / F.col("n")).alias("fraction"))
