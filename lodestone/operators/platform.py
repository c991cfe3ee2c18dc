"""Platform effects: factors by variable between two measurements of the same categories, and subsampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.elementwise import complete_choice, scale
from lodestone.operators.packed import ENTRIES


def rescaling_factors(a: np.ndarray, b: np.ndarray, reg_a: float = 0.0, reg_b: float = 0.0, tol: float = 1e-10, rounds: int = 2000) -> np.ndarray:
    """Factors g of variables (columns), so that diag(w) a diag(g) is close to b in least squares, with g and the weights w of
    profiles (rows) non-negative: alternating closed-form least squares, regularised towards 1; mean(w) = 1."""
    p, n = a.shape
    w = np.ones(p)
    g = np.divide(b.sum(0), a.sum(0), out=np.ones(n), where=a.sum(0) > 0)
    for _ in range(rounds):
        before = g
        wa = w[:, None] * a
        den = (wa * wa).sum(0) + reg_a * p
        g = np.maximum(0, np.divide((wa * b).sum(0) + reg_a * p, den, out=np.ones(n), where=den > 0))
        ag = a * g
        den = (ag * ag).sum(1) + reg_b * n
        w = np.maximum(0, np.divide((ag * b).sum(1) + reg_b * n, den, out=np.ones(p), where=den > 0))
        m = w.mean() or 1.0
        w, g = w / m, g * m
        if np.abs(g - before).max() <= tol * max(1.0, np.abs(g).max()):
            break
    return g


def normalize_platform(x: DataFrame, labels: DataFrame | None, other: DataFrame, weights: DataFrame | None = None, return_factors: bool = False) -> DataFrame:
    """x with variables rescaled to the platform of ``other``: from reads by (hard or soft) label of both; without
    labels on either side from total reads. Variables that either side lacks get factor 0."""

    def reads(m, w):
        if w is None:
            return m.groupBy("var").agg(F.sum("value").alias("s")).withColumn("category", F.lit("all"))
        w = w if "weight" in w.columns else w.withColumn("weight", F.lit(1.0))
        return m.join(w, "obs").groupBy("var", "category").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))

    both = labels is not None and weights is not None
    a = reads(x, labels if both else None)
    b = reads(other, weights if both else None).withColumnRenamed("s", "t")
    table = a.join(b, ["var", "category"])
    n = table.count()
    if n > ENTRIES:
        raise ValueError(f"{n} reads by variable and category; at most {ENTRIES} are fitted at once")
    table = table.toPandas()
    var, cat = sorted(set(table["var"])), sorted(set(table["category"]))
    pa, pb = np.zeros((len(cat), len(var))), np.zeros((len(cat), len(var)))
    i, j = table["category"].map({c: k for k, c in enumerate(cat)}), table["var"].map({v: k for k, v in enumerate(var)})
    pa[i, j], pb[i, j] = table["s"], table["t"]
    g = rescaling_factors(pa / pa.sum(), pb / pb.sum())
    factors = x.sparkSession.createDataFrame([(v, float(f)) for v, f in zip(var, g)], "var string, factor double")
    if return_factors:
        return factors
    return scale(x, factors, "var", fill=0.0).filter("value > 0")


def random_platform_effect(x: DataFrame, log10_mean: float = 0.0, log10_std: float = 0.6, seed: int = 0, round: bool = False) -> tuple[DataFrame, DataFrame]:
    """(x scaled, factors): factors 10^Laplace by variable, from a hash of its name."""
    u = (F.pmod(F.xxhash64("var", F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53) - 0.5
    laplace = F.lit(log10_mean) - F.lit(log10_std / 2**0.5) * F.signum(u) * F.log1p(-2 * F.abs(u))
    factors = x.select("var").distinct().withColumn("factor", F.pow(F.lit(10.0), laplace))
    return scale(x, factors, "var", round=round), factors


def subsample_annotation(labels: DataFrame, modification: dict[str, float], range_factor: float = 1.0, seed: int = 0) -> DataFrame:
    """Observations drawn so that each category's number is multiplied by its modification over ``range_factor``; a key is a
    category or the beginning of just one."""
    cats = {r["category"]: r["n"] for r in labels.filter("category is not null").groupBy("category").agg(F.count("*").alias("n")).collect()}
    sizes = dict.fromkeys(cats, 1.0)
    for key, factor in modification.items():
        hits = [key] if key in cats else [c for c in cats if c.startswith(key)]
        if len(hits) != 1:
            raise KeyError(f"{key!r} fits {hits}")
        sizes[hits[0]] = factor
    size = labels.sparkSession.createDataFrame([(c, int(cats[c] * f / range_factor)) for c, f in sizes.items()], "category string, n long")
    return complete_choice(labels, "category", "obs", size, seed)
