"""Co-occurrence of labels by distance, and distance coordinates of labels."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.spatial import sparse_distances


def _counts(distances: DataFrame, labels: DataFrame, centers: DataFrame, top: float, step: float) -> DataFrame:
    """(sample, annotation, center, k, n): weights of ordered pairs by interval; interval k covers ((n-1-k) steps) below the top."""
    n = ceil(top / step)
    a = labels.select(F.col("obs").alias("i"), F.col("sample"), F.col("category").alias("annotation"), F.col("weight").alias("wa"))
    c = centers.select(F.col("obs").alias("j"), F.col("category").alias("center"), F.col("weight").alias("wc"))
    d = distances.filter("distance > 0").withColumn("k", (F.lit(n - 1) - F.floor((F.lit(top) - F.col("distance")) / step)).cast("int")).filter((F.col("k") >= 0) & (F.col("k") < n))
    return d.join(a, "i").join(c, "j").groupBy("sample", "annotation", "center", "k").agg(F.sum(F.col("wa") * F.col("wc")).alias("c"))


def scores(counts: DataFrame, labels: DataFrame, centers: DataFrame, n: int, top: float, step: float) -> DataFrame:
    """Counts on the full grid, with occurrence ((n+1) shares of annotations near a center over their shares near any)
    and composition (shares of annotations near a center), by sample."""
    grid = labels.select("sample", F.col("category").alias("annotation")).distinct().join(centers.select("sample", F.col("category").alias("center")).distinct(), "sample")
    # categories of any sample count in every sample
    cats = grid.select("annotation").distinct().crossJoin(grid.select("center").distinct())
    full = grid.select("sample").distinct().crossJoin(cats).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(counts, ["sample", "annotation", "center", "k"], "left").fillna(0.0, ["c"])
    w = lambda *keys: Window.partitionBy("sample", "k", *keys)
    nn = F.col("c") + 1
    share = nn / F.sum(nn).over(w("center"))
    overall = F.sum(nn).over(w("annotation")) / F.sum(nn).over(w())
    lo = F.greatest(F.lit(0.0), F.lit(top) - (F.lit(n) - F.col("k")) * step)
    return full.select("sample", "annotation", "center", "k", lo.alias("lo"), (F.lit(top) - (F.lit(n - 1) - F.col("k")) * step).alias("hi"), "c", (share / overall).alias("occ"), share.alias("composition"))


def co_occurrence(points: DataFrame, labels: DataFrame, top: float, step: float, centers: DataFrame | None = None, lowest: float = 0.0) -> DataFrame:
    """Scores by sample, annotation, center and distance interval, and their mean over samples as sample null.

    points(obs, sample, x, y[, section]); labels and centers (obs, category, weight), centers defaulting to labels."""
    groups = [c for c in ("sample", "section") if c in points.columns]
    d = sparse_distances(points, top, groups)
    if lowest:
        d = d.filter(F.col("distance") > lowest)
    where = points.select("obs", F.col("sample").cast("string").alias("sample")).filter("sample is not null")
    lab, cen = labels.join(where, "obs"), (centers if centers is not None else labels).join(where, "obs")
    s = scores(_counts(d, lab, cen, top, step), lab, cen, ceil(top / step), top, step)
    mean = s.groupBy("annotation", "center", "k", "lo", "hi").agg(F.sum("c").alias("c"), F.avg("occ").alias("occ"), F.avg("composition").alias("composition"))
    return s.unionByName(mean.withColumn("sample", F.lit(None).cast("string")))


def co_occurrence_matrix(points: DataFrame, labels: DataFrame, top: float, centers: DataFrame | None = None) -> DataFrame:
    return co_occurrence(points, labels, top, top, centers)


def permutation_scores(points: DataFrame, labels: DataFrame, top: float, step: float, permutations: int = 10, seed: int = 0) -> DataFrame:
    """(annotation, center, k, z): ln(n+1) against its mean and deviation when the annotation labels are shuffled within
    samples; hard labels. Distances are computed once, each pair then carries the labels of all permutations."""
    groups = [c for c in ("sample", "section") if c in points.columns]
    d = sparse_distances(points, top, groups)
    where = points.select("obs", F.col("sample").cast("string").alias("sample")).filter("sample is not null")
    lab = labels.join(where, "obs").select("obs", "sample", "category")
    runs = lab.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    by_name = F.row_number().over(Window.partitionBy("sample", "r").orderBy("obs"))
    by_hash = F.row_number().over(Window.partitionBy("sample", "r").orderBy(F.xxhash64("obs", "r", F.lit(seed)), "obs"))
    place = runs.withColumn("p", by_name).select("sample", "r", "p", "obs")
    drawn = runs.withColumn("p", by_hash).select("sample", "r", "p", "category")
    shuffled = place.join(drawn, ["sample", "r", "p"]).select("obs", "r", "category").filter("r > 0").union(lab.select("obs", F.lit(0).alias("r"), "category"))
    n = ceil(top / step)
    dk = d.withColumn("k", (F.lit(n - 1) - F.floor((F.lit(top) - F.col("distance")) / step)).cast("int"))
    c = dk.join(shuffled.select(F.col("obs").alias("i"), "r", F.col("category").alias("annotation")), "i").join(lab.select(F.col("obs").alias("j"), F.col("category").alias("center")), "j")
    counts = c.groupBy("r", "annotation", "center", "k").agg(F.count("*").alias("c"))
    cats = lab.select(F.col("category").alias("annotation")).distinct()
    grid = cats.crossJoin(cats.withColumnRenamed("annotation", "center")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    v = F.log1p(F.col("c"))
    full = grid.join(counts, ["r", "annotation", "center", "k"], "left").fillna(0, ["c"]).withColumn("v", v)
    out = full.groupBy("annotation", "center", "k").agg(F.max(F.when(F.col("r") == 0, F.col("v"))).alias("v"), F.avg(F.when(F.col("r") > 0, F.col("v"))).alias("m"), F.stddev_pop(F.when(F.col("r") > 0, F.col("v"))).alias("s"))
    return out.select("annotation", "center", "k", F.try_divide(F.col("v") - F.col("m"), F.col("s")).alias("z"))


def annotation_coordinate(points: DataFrame, labels: DataFrame, critical: float, top: float, step: float) -> DataFrame:
    """(obs, category, distance): where the weight of a category within the distance of a point first exceeds ``critical``:
    the middle of that distance bin; null if it never does within ``top``. The point itself counts, at distance 0."""
    groups = [c for c in ("sample", "section") if c in points.columns]
    d = sparse_distances(points, top, groups).select("i", "j", "distance")
    own = points.select(F.col("obs").alias("i"), F.col("obs").alias("j"), F.lit(0.0).alias("distance"))
    n = ceil(top / step)
    hist = d.union(own).join(labels.select(F.col("obs").alias("j"), "category", "weight"), "j").withColumn("bin", F.least(F.lit(n - 1), F.floor(F.col("distance") / step)).cast("int")).groupBy("i", "category", "bin").agg(F.sum("weight").alias("w"))
    run = F.sum("w").over(Window.partitionBy("i", "category").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = hist.withColumn("run", run).groupBy("i", "category").agg(F.min(F.when(F.col("run") > critical, F.col("bin"))).alias("bin"))
    return first.select(F.col("i").alias("obs"), "category", ((F.col("bin") + 0.5) * step).alias("distance"))
