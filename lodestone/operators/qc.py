"""Quality filters of count matrices, profiles and soft labels."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.aggregate import reference_profiles
from lodestone.runtime import cut


def counts_validity(x: DataFrame, delta: float = 1e-4) -> DataFrame:
    """One row (entries, negative, fractional, valid) over all stored values."""
    v = F.col("value")
    out = x.agg(F.count("*").alias("entries"), F.count_if(v < 0).alias("negative"), F.count_if(F.abs(v - F.rint(v)) > delta).alias("fractional"))
    return out.withColumn("valid", (F.col("negative") == 0) & (F.col("fractional") == 0))


def filter_fixpoint(frames: list[DataFrame], min_counts_per_gene: float | None = None, min_counts_per_cell: float | None = None, min_cells_per_gene: int | None = None, min_genes_per_cell: int | None = None, remove_constant_genes: bool = True, remove_zero_cells: bool = True) -> list[DataFrame]:
    """Matrices with the variables that pass in all of them and the observations that pass in each, filtered in turns until
    nothing changes. A variable is constant if all observations (zeros included) have one value; that is not
    asked of a matrix with one observation."""
    frames = [cut(f.filter("value <> 0").select("obs", "var", "value")) for f in frames]
    while True:  # every round but the last removes entries
        good = None
        for f in frames:
            n_obs = f.select("obs").distinct().count()
            stats = f.groupBy("var").agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            ok = F.lit(True)
            if min_counts_per_gene is not None:
                ok &= F.col("s") >= min_counts_per_gene
            if min_cells_per_gene is not None:
                ok &= F.col("n") >= min_cells_per_gene
            if remove_constant_genes and n_obs > 1:
                ok &= (F.col("n") < n_obs) | (F.col("lo") < F.col("hi"))
            names = stats.filter(ok).select("var")
            good = names if good is None else good.join(names, "var", "left_semi")
        good = cut(good)
        new = []
        for f in frames:
            g = f.join(good, "var", "left_semi")
            stats = g.groupBy("obs").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
            ok = F.col("s") > 0 if remove_zero_cells else F.lit(True)
            if min_counts_per_cell is not None:
                ok &= F.col("s") >= min_counts_per_cell
            if min_genes_per_cell is not None:
                ok &= F.col("n") >= min_genes_per_cell
            new.append(cut(g.join(stats.filter(ok).select("obs"), "obs", "left_semi")))
        if [a.count() for a in new] == [b.count() for b in frames]:
            return new
        frames = new


def filter_reference_genes(x: DataFrame, labels: DataFrame, min_log2foldchange: float | None = 1.0, min_expression: float | None = 1e-5, remove_prefix: str | None = None) -> DataFrame:
    """(var): variables whose profile in some category exceeds the mean of the other categories' profiles by the fold
    change, and which reach ``min_expression`` somewhere (None: any); optionally none whose name begins with a prefix in any case."""
    p = reference_profiles(x, labels)
    cats = labels.filter("category is not null").select("category").distinct()
    grid = p.select("var").distinct().crossJoin(F.broadcast(cats)).join(p, ["var", "category"], "left").fillna(0.0, ["p"])
    w = Window.partitionBy("var")
    e = F.col("p") + 1e-30
    total, k = F.sum(e).over(w), F.count("*").over(w)
    up = F.lit(True) if min_log2foldchange is None else F.log(F.try_divide(e, F.try_divide(total - e, k - 1))) >= log(2) * min_log2foldchange
    good = grid.withColumn("up", up).groupBy("var").agg(F.bool_or("up").alias("up"), F.max("p").alias("most")).filter("up")
    if min_expression is not None:
        good = good.filter(F.col("most") >= min_expression)
    if remove_prefix:
        good = good.filter(~F.startswith(F.lower("var"), F.lit(remove_prefix.lower())))
    return good.select("var")


def filter_weights(w: DataFrame, key: str, column: str, fill_na: bool | None = None, fill_negative: bool | None = None) -> DataFrame:
    """Rows of the keys whose ``column`` sums to more than 0. Missing and negative values: None is an error, True sets them
    to 0, False counts them as 0 but leaves them."""
    v = F.col(column)
    missing = v.isNull() | F.isnan(v)
    bad = w.agg(F.count_if(missing).alias("na"), F.count_if(~missing & (v < 0)).alias("neg")).first()
    if bad["na"] and fill_na is None:
        raise ValueError(f"{bad['na']} missing values")
    if bad["neg"] and fill_negative is None:
        raise ValueError(f"{bad['neg']} negative values")
    counted = F.when(missing | (v < 0), 0.0).otherwise(v)
    keep = w.groupBy(key).agg(F.sum(counted).alias("_s")).filter("_s > 0").select(key)
    out = w.join(keep, key, "left_semi")
    if fill_na:
        out = out.withColumn(column, F.when(missing, 0.0).otherwise(v))
    if fill_negative:
        out = out.withColumn(column, F.when(v < 0, 0.0).otherwise(v))
    return out


def highly_variable(x: DataFrame, n_obs: int, top: int, bins: int = 20) -> DataFrame:
    """(var, mean, dispersion, normalised, rank) of the ``top`` variables by dispersion (variance / mean, zeros included)
    standardised within bins of equal width of the mean."""
    m = F.sum("value") / n_obs
    var = (F.sum(F.col("value") * F.col("value")) - n_obs * m * m) / max(1, n_obs - 1)
    s = x.groupBy("var").agg(m.alias("mean"), var.alias("v")).withColumn("dispersion", F.try_divide("v", "mean"))
    ends = s.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    s = s.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("mean") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)))
    w = Window.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(w)
    s = s.withColumn("normalised", F.when(sd > 0, (F.col("dispersion") - F.avg("dispersion").over(w)) / sd).otherwise(1.0))
    # one row a variable
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("normalised"), "var"))).filter(F.col("rank") <= top).select("var", "mean", "dispersion", "normalised", "rank")


def rank_markers(x: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """(category, var, t, rank): the variables with the greatest Welch t of log1p counts of a category against all others."""
    labels = labels.filter("category is not null").select("obs", "category")
    n = labels.groupBy("category").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    s = x.withColumn("v", F.log1p("value")).join(labels, "obs").groupBy("category", "var").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    grid = s.select("var").distinct().crossJoin(F.broadcast(n)).join(s, ["category", "var"], "left").fillna(0.0, ["s", "q"])
    w = Window.partitionBy("var")
    rest_n, rest_s, rest_q = F.col("all") - F.col("n"), F.sum("s").over(w) - F.col("s"), F.sum("q").over(w) - F.col("q")
    mean = lambda a, k: F.try_divide(a, k)
    spread = lambda q, a, k: F.try_divide(q - F.try_divide(a * a, k), (k - 1) * k)
    t = F.try_divide(mean(F.col("s"), F.col("n")) - mean(rest_s, rest_n), F.sqrt(F.greatest(F.lit(0.0), spread(F.col("q"), F.col("s"), F.col("n")) + spread(rest_q, rest_s, rest_n))))
    scored = grid.withColumn("t", t).filter("t is not null and not isnan(t)")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("t"), "var"))).filter(F.col("rank") <= top).select("category", "var", "t", "rank")
