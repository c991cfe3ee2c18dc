"""Binning, codes, distances and neighbour graphs of points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.elementwise import quantiles
from lodestone.operators.nearby import near_pairs, tiled
from lodestone.operators.similarity import cdist
from lodestone.runtime import cut


def bin_points(df: DataFrame, size: float, columns: Sequence[str] = ("x", "y"), names: Sequence[str] | None = None, shift: float = 0.0) -> DataFrame:
    """Bin numbers of each coordinate, floor((x - min - shift) / size)."""
    names = names or [f"{c}_bin" for c in columns]
    low = df.agg(*[F.min(c).alias(f"_m{k}") for k, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(low))
    for k, (c, n) in enumerate(zip(columns, names)):
        out = out.withColumn(n, F.floor((F.col(c) - F.col(f"_m{k}") - F.lit(shift)) / F.lit(size)).cast("long"))
    return out.drop(*[f"_m{k}" for k in range(len(columns))])


def codes(df: DataFrame, keys: Sequence[str], name: str = "code", other: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Dense code of the combination of keys: in sorted order over df and ``other`` or, with an ``order`` column and no other
    frame, in order of first appearance. Codes are ranks of distinct combinations, counted in ranges, not in one window."""
    combos = df.groupBy(*keys).agg(F.min(order).alias("_o")) if order else df.select(*keys).distinct()
    if other is not None:
        combos = combos.select(*keys).union(other.select(*keys)).distinct()
    by = ["_o"] if order and other is None else list(keys)
    parts = combos.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    parts = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_id")))
    parts = cut(parts)  # ranges are sampled: both uses must see the same ones
    n = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = n.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # one row a partition
    table = parts.join(F.broadcast(before), "_p").select(*keys, (F.col("_b") + F.col("_r") - 1).cast("long").alias(name))
    return df.join(table, list(keys))


def dense_distances(a: DataFrame, b: DataFrame, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """(i, j, distance) of all pairs; for small inputs only, since that is what it returns."""
    left = a.select(F.col("obs").alias("i"), *[F.col(c).alias(f"_a{c}") for c in columns])
    right = b.select(F.col("obs").alias("j"), *[F.col(c).alias(f"_b{c}") for c in columns])
    square = sum(((F.col(f"_a{c}") - F.col(f"_b{c}")) ** 2 for c in columns), F.lit(0.0))
    return left.crossJoin(right).select("i", "j", F.sqrt(square).alias("distance"))


def sparse_distances(points: DataFrame, radius: float, groups: Sequence[str] = ()) -> DataFrame:
    """(i, j, distance), both ways, of different points at 0 < distance <= radius."""
    d = near_pairs(points, radius, groups=groups).filter("distance > 0")
    way = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "distance")
    return d.select(F.inline(F.array(way("key_a", "key_b"), way("key_b", "key_a"))))


def with_annotation(distances: DataFrame, weights: DataFrame, annotation: float | str, scale: float = 1.0) -> DataFrame:
    """sqrt(d^2 + a^2), where a is 0 between equal hard labels and a constant otherwise (a number), or scale times a
    distance of soft labels (a metric name)."""
    if isinstance(annotation, (int, float)):
        hard = lambda n, k: weights.select(F.col("obs").alias(n), F.col("category").alias(k))
        d = distances.join(hard("i", "ci"), "i").join(hard("j", "cj"), "j")
        a = F.when(F.col("ci") == F.col("cj"), 0.0).otherwise(float(annotation) * scale)
        return d.select("i", "j", F.sqrt(F.col("distance") ** 2 + a**2).alias("distance"))
    soft = weights.select("obs", F.col("category").alias("var"), F.col("weight").alias("value"))
    if annotation in ("h2", "bc", "hellinger", "euclidean"):
        root = annotation in ("h2", "bc", "hellinger")
        v = F.sqrt("value") if root else F.col("value")
        s = soft.withColumn("value", v)
        side = lambda n, k: s.select(F.col("obs").alias(n), "var", F.col("value").alias(k))
        dot = distances.join(side("i", "a"), "i").join(side("j", "b"), ["j", "var"]).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
        norm = lambda n, k: s.groupBy(F.col("obs").alias(n)).agg(F.sum(F.col("value") ** 2).alias(k))
        d = distances.join(dot, ["i", "j"], "left").fillna(0.0, ["ab"]).join(norm("i", "aa"), "i").join(norm("j", "bb"), "j")
        a = {"euclidean": F.sqrt(F.greatest(F.lit(0.0), F.col("aa") + F.col("bb") - 2 * F.col("ab"))), "hellinger": F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("ab")))}.get(annotation, F.greatest(F.lit(0.0), 1 - F.col("ab")))
        return d.select("i", "j", F.sqrt(F.col("distance") ** 2 + (a * scale) ** 2).alias("distance"))
    a = cdist(soft, soft, annotation).withColumnRenamed("distance", "_a")
    return distances.join(a, ["i", "j"]).select("i", "j", F.sqrt(F.col("distance") ** 2 + (F.col("_a") * scale) ** 2).alias("distance"))


def affinity(distances: DataFrame, sigma: float) -> DataFrame:
    """(i, j, w): exp(-d^2 / 2 sigma^2) at the stored distances."""
    return distances.select("i", "j", F.exp(-F.col("distance") ** 2 / (2 * sigma**2)).alias("w"))


def strip(distances: DataFrame, radius: float) -> DataFrame:
    """Distances up to the radius, mirrored from the lower triangle."""
    low = distances.filter((F.col("i") > F.col("j")) & (F.col("distance") <= radius))
    return low.unionByName(low.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))


def periodic_distance(a, b, c, d):
    """Distance of (a, b) and (c, d) on the unit torus, as a column."""
    wrap = lambda u, v: F.least(F.abs(u - v), 1 - F.abs(u - v))
    return F.hypot(wrap(a, c), wrap(b, d))


def nearest_labelled(points: DataFrame, labelled: DataFrame, k: int, group: str | None = None, tile_points: int = 4096) -> DataFrame:
    """(i, j, distance, rank): for each point its k nearest labelled points of the group; equals by name.

    Points and the labelled points around them meet in tiles (``nearby.tiled``) within a radius that holds k labelled points at
    their mean density; points that found fewer go on with three times the radius, until it spans the groups."""
    g = F.struct(F.col(group).cast("string").alias("g0")) if group else F.struct(F.lit("").alias("g0"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    side = lambda d, left: d.select(F.col("obs").cast("string").alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), g.alias("g"), F.lit(left).alias("l"), F.lit(not left).alias("r")).filter(F.col("k").isNotNull() & fine("x") & fine("y") & F.col("g.g0").isNotNull())
    asks, known = cut(side(points, True).distinct()), cut(side(labelled, False).distinct())
    frame = known.groupBy("g").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{m}") for c in "xy" for m, f in (("0", F.min), ("1", F.max))])
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    radius = frame.select(F.sqrt(F.greatest(wide * high, F.pow(F.greatest(wide, high), F.lit(2)) / F.col("n")) * (1.5 * k) / F.col("n")).alias("v")).agg(F.percentile_approx("v", 0.5)).first()[0] or 1.0
    ends = asks.unionByName(known).groupBy("g").agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xy"]).agg(F.max(F.hypot("x", "y"))).first()[0] or 0.0
    schema = "i string, j string, distance double"

    def searcher(radius: float):
        def search(left, right):
            (ka, a), (kb, b) = left, right
            order = np.argsort(kb, kind="stable")
            kb, b = kb[order], b[order]
            step = max(1, 2_000_000 // len(b))
            for at in range(0, len(a), step):
                d = np.sqrt(((a[at : at + step, None] - b[None]) ** 2).sum(2))
                last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero(d <= np.minimum(last, radius)[:, None])
                far = d[i, j]
                order = np.lexsort([j, far, i])
                i, j, far = i[order], j[order], far[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pd.DataFrame({"i": ka[at + i[first]], "j": kb[j[first]], "distance": far[first]})

        return search

    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    parts = []
    while True:
        last = radius >= ends
        found = tiled(asks.unionByName(known), radius, searcher(radius), schema, tile_points)
        found = cut(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        if last:
            parts.append(found)
            break
        done = found.filter(F.col("rank") == k).select(F.col("i").alias("k"))
        parts.append(found.join(done.withColumnRenamed("k", "i"), "i", "left_semi"))
        asks = cut(asks.join(done, "k", "left_anti"))
        if not asks.take(1):
            break
        radius *= 3
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_regions(points: DataFrame, k: int = 1, group: str | None = None) -> DataFrame:
    """(obs, region): null regions filled with the most frequent region of the k nearest labelled points; the smallest among equals."""
    fine = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    near = nearest_labelled(fine.filter("region is null"), fine.filter("region is not null"), k, group)
    votes = near.join(points.select(F.col("obs").alias("j"), "region"), "j").groupBy("i", "region").count()
    best = votes.groupBy(F.col("i").alias("obs")).agg(F.min_by("region", F.struct(-F.col("count"), "region")).alias("_r"))
    return points.join(best, "obs", "left").select("obs", F.coalesce("region", "_r").alias("region"))


def balanced_cuts(df: DataFrame, value: str, n: int, group: str | None = None, separation: float = 0.0) -> DataFrame:
    """df with ``interval``: the number of cuts below the value. Cuts lie midway between the neighbours of the round(k n / m)-th
    values (halves to even) and halve the group evenly; values nearer than separation / 2 to a cut, or groups of fewer than n, get null."""
    g = [group] if group else []
    w = Window.partitionBy(*g).orderBy("_v")
    ranked = df.select(*g, F.col(value).alias("_v")).withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(*g)))
    ids = ranked.select(*g, "_m").distinct().filter(F.col("_m") >= n).withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(n - 1)))) if n > 1 else None
    if ids is None:
        return df.withColumn("interval", F.lit(0))
    ids = ids.withColumn("_id", F.bround(F.col("_j") * F.col("_m") / n, 0).cast("int"))
    at = ids.withColumn("_k", F.explode(F.array("_id", F.col("_id") + 1))).drop("_m").join(ranked, [*g, "_k"])
    cuts = at.groupBy(*g, "_j").agg(F.avg("_v").alias("_c"))
    cuts = cuts.groupBy(*g).agg(F.array_sort(F.collect_list("_c")).alias("_c")) if g else cuts.agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    out = df.join(F.broadcast(cuts), g, "left") if g else df.crossJoin(F.broadcast(cuts))
    v = F.col(value)
    near = F.exists("_c", lambda c: F.abs(v - c) < separation / 2)
    label = F.when(F.col("_c").isNull() | near | (F.size("_c") == 0), None).otherwise(F.size(F.filter("_c", lambda c: c < v)))
    return out.withColumn("interval", label.cast("int")).drop("_c")


def quantile_labels(df: DataFrame, value: str, n: int) -> DataFrame:
    """``quantile``: the number of inner n-quantiles strictly below the value (intervals open on the left), repeated quantiles once."""
    cuts = sorted(set(quantiles(df, value, [k / n for k in range(1, n)])))
    below = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return df.withColumn("quantile", F.when(F.col(value).isNotNull(), below).cast("int"))


def principal_axis(df: DataFrame, group: str) -> DataFrame:
    """(group, ax, ay): first principal axis of x, y, from the covariances in closed form; ax >= 0."""
    c = df.groupBy(group).agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    angle = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    return c.select(group, F.cos(angle).alias("ax"), F.sin(angle).alias("ay"))


def split_spatial_samples(df: DataFrame, parts: Sequence[tuple[str, int]], sample: str = "sample", buffer: float = 0.0) -> DataFrame:
    """``label``: sample|k|... from successive balanced cuts along 'x', 'y' or the first 'principal' axis; buffers are null."""
    out = df.withColumn("label", F.col(sample).cast("string"))
    for direction, n in parts:
        if direction == "principal":
            out = out.join(principal_axis(out.filter("label is not null"), "label"), "label", "left").withColumn("_v", F.col("x") * F.col("ax") + F.col("y") * F.col("ay")).drop("ax", "ay")
        else:
            out = out.withColumn("_v", F.col(direction))
        gone = out.filter("label is null").drop("_v")
        cutted = balanced_cuts(out.filter("label is not null"), "_v", n, "label", buffer)
        # concat is null in the buffer
        out = cutted.withColumn("label", F.concat("label", F.lit("|"), F.col("interval").cast("string"))).drop("_v", "interval").unionByName(gone)
    return out
