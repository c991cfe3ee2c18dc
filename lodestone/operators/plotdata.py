"""The tables behind figures: colours, significances, orderings, comparisons and coloured points."""

from __future__ import annotations

import colorsys

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def default_colors(n: int, offset: float = 0.0) -> list[tuple[float, float, float]]:
    """n colours evenly around the hue circle."""
    return [colorsys.hsv_to_rgb((offset + k / max(n, 1)) % 1, 0.75, 0.9) for k in range(n)]


def merge_colors(colors: DataFrame, mapping: DataFrame) -> DataFrame:
    """(category, r, g, b, a): mean colour of the fine categories (fine, r, g, b, a) of a coarse one; mapping(fine, category)."""
    return colors.join(mapping, "fine").groupBy("category").agg(*[F.avg(c).alias(c) for c in "rgba"])


def mix_colors(weights: DataFrame, colors: DataFrame, mode: str = "rgb") -> DataFrame:
    """(obs, r, g, b): weighted mean colour of soft labels; colors(category, r, g, b). Mode 'xyv' averages hues as
    directions, so that opposite hues give grey, and keeps the mean brightness."""
    w = weights.join(F.broadcast(colors), "category")  # one row a category
    if mode == "rgb":
        return w.groupBy("obs").agg(*[F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum("weight")).alias(c) for c in "rgb"])
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    d = high - low
    sixth = F.when(d == 0, 0.0).when(high == F.col("r"), (F.col("g") - F.col("b")) / F.nullif(d, F.lit(0.0))).when(high == F.col("g"), 2 + (F.col("b") - F.col("r")) / F.nullif(d, F.lit(0.0))).otherwise(4 + (F.col("r") - F.col("g")) / F.nullif(d, F.lit(0.0)))
    angle, s = sixth * (np.pi / 3), F.try_divide(d, high)
    mean = lambda c: F.try_divide(F.sum(F.col("weight") * c), F.sum("weight"))
    m = w.groupBy("obs").agg(mean(F.coalesce(s, F.lit(0.0)) * F.cos(angle)).alias("x"), mean(F.coalesce(s, F.lit(0.0)) * F.sin(angle)).alias("y"), mean(high).alias("v"))
    hue, sat = F.pmod(F.atan2("y", "x") / (np.pi / 3), F.lit(6.0)), F.least(F.lit(1.0), F.hypot("x", "y"))

    def channel(n):
        k = F.pmod(F.lit(float(n)) + hue, F.lit(6.0))
        return F.col("v") * (1 - sat * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))

    return m.select("obs", channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def stars(p: str = "p_adjusted"):
    """Star code at .05, .01 and .001."""
    c = F.col(p)
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").otherwise("")


def significance_map(tests: DataFrame, p: str = "p_adjusted", p_max: float = 0.05) -> DataFrame:
    """(value, group, p, enrichment, signed, stars): the direction with the smaller p; signed is -ln p for enriched and ln p
    for purified values, 0 above ``p_max``."""
    best = tests.filter(F.col(p).isNotNull()).groupBy("value", "group").agg(F.min(F.struct(F.col(p).alias("p"), "enrichment")).alias("b")).select("value", "group", "b.p", "b.enrichment")
    sign = F.when(F.col("enrichment") == "enriched", -1.0).otherwise(1.0)
    return best.withColumn("signed", F.when(F.col("p") > p_max, 0.0).otherwise(sign * F.log(F.greatest("p", F.lit(1e-300))))).withColumn("stars", stars("p"))


def diagonal_order(matrix: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Row and column orders that move the greatest entries to the diagonal."""
    rows, cols = np.arange(matrix.shape[0]), np.arange(matrix.shape[1])
    for _ in range(rounds):
        rows = rows[np.argsort(matrix[np.ix_(rows, cols)].argmax(1), kind="stable")]
        cols = cols[np.argsort(matrix[np.ix_(rows, cols)].argmax(0), kind="stable")]
    return rows, cols


def linkage_order(matrix: np.ndarray) -> list[int]:
    """Leaf order of an average-linkage tree of the rows by cosine distance (small matrices)."""
    x = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(matrix))]
    while len(groups) > 1:
        _, a, b = min((d[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    return groups[0] if groups else []


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(obs, category, a, b): weights of two annotations side by side, 0 where one lacks a label."""
    return a.select("obs", "category", F.col("weight").alias("a")).join(b.select("obs", "category", F.col("weight").alias("b")), ["obs", "category"], "full").fillna(0.0, ["a", "b"])


def scatter_frame(points: DataFrame, weights: DataFrame) -> DataFrame:
    """(obs, x, y, category, share): weights scaled to [0, 1] by category."""
    w = Window.partitionBy("category")
    lo, hi = F.min("weight").over(w), F.max("weight").over(w)
    return points.select("obs", "x", "y").join(weights, "obs").select("obs", "x", "y", "category", F.when(hi > lo, (F.col("weight") - lo) / (hi - lo)).otherwise(1.0).alias("share"))


def label_positions(points: DataFrame, weights: DataFrame) -> DataFrame:
    """(category, x, y): weighted medians of the coordinates: the first values at which the cumulated weight reaches half."""
    joined = points.select("obs", "x", "y").join(weights.filter("weight > 0"), "obs")
    out = None
    for c in "xy":
        n = joined.groupBy("category", c).agg(F.sum("weight").alias("w"))
        w = Window.partitionBy("category")
        run = F.sum("w").over(w.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        m = n.withColumn("run", run).withColumn("t", F.sum("w").over(w)).filter(F.col("run") >= F.col("t") / 2).groupBy("category").agg(F.min(c).alias(c))
        out = m if out is None else out.join(m, "category")
    return out


def annotated_heatmap(x: DataFrame, labels: DataFrame, markers: DataFrame) -> DataFrame:
    """(obs, category, var, marker_of, value): log counts per 10,000 of marker variables (var, category), for figures ordered by both groups."""
    total = x.groupBy("obs").agg(F.sum("value").alias("n"))
    m = markers.select("var", F.col("category").alias("marker_of"))
    return x.join(F.broadcast(m), "var").join(total, "obs").join(labels, "obs").select("obs", "category", "var", "marker_of", F.log1p(F.col("value") / F.col("n") * 1e4).alias("value"))  # few markers
