"""Scaling, normalisation and relabelling of long matrices and soft labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """a / b at the entries stored in both."""
    return a.join(b.select("obs", "var", F.col("value").alias("_b")), ["obs", "var"]).select("obs", "var", F.try_divide("value", "_b").alias("value"))


def transform(x: DataFrame, how: str) -> DataFrame:
    """log1p, log or sqrt of the stored entries."""
    f = {"log1p": F.log1p, "log": F.log, "sqrt": F.sqrt}[how]
    return x.withColumn("value", f("value"))


def scale(x: DataFrame, factors: DataFrame, axis: str, round: bool = False, fill: float | None = None) -> DataFrame:
    """value * factor by obs or var (``axis``); halves round to even. Without ``fill``, entries without a factor drop out."""
    out = x.join(factors.select(axis, F.col("factor").alias("_f")), axis, "inner" if fill is None else "left")
    v = F.col("value") * (F.col("_f") if fill is None else F.coalesce("_f", F.lit(fill)))
    return out.select("obs", "var", (F.bround(v, 0) if round else v).alias("value"))


def normalise(x: DataFrame, by: str, column: str, total: float = 1.0) -> DataFrame:
    """``column`` divided by its sum over ``by``, times ``total``; groups that sum to 0 become null."""
    sums = x.groupBy(by).agg(F.sum(column).alias("_s"))
    return x.join(sums, by).withColumn(column, F.try_divide(F.col(column), F.col("_s")) * F.lit(total)).select(*x.columns)


def normalize_result(weights: DataFrame) -> DataFrame:
    """Soft labels with negative weights set to 0 and sums of 1."""
    return normalise(weights.withColumn("weight", F.greatest(F.lit(0.0), "weight")), "obs", "weight")


def log_normalize(x: DataFrame, target: float = 1e4) -> DataFrame:
    """Every observation scaled to ``target``, then log1p."""
    return transform(normalise(x, "obs", "value", target), "log1p")


def normalize_total(x: DataFrame, target: float | None = None) -> DataFrame:
    """Every observation scaled to ``target``, by default the median total."""
    sums = x.groupBy("obs").agg(F.sum("value").alias("_s"))
    if target is not None:
        return normalise(x, "obs", "value", target)
    (middle,) = quantiles(sums, "_s", [0.5]) or (None,)
    return x.join(sums, "obs").select("obs", "var", (F.try_divide("value", "_s") * F.lit(middle).cast("double")).alias("value"))


def inverse_mapping(mapping: dict[str, list[str]]) -> dict[str, str]:
    """{fine: coarse} of {coarse: [fine, ...]}; a fine label of two coarse ones is an error."""
    out: dict[str, str] = {}
    for coarse, fines in mapping.items():
        for fine in fines:
            if fine in out:
                raise ValueError(f"{fine!r} belongs to {out[fine]!r} and {coarse!r}")
            out[fine] = coarse
    return out


def merge_annotation(weights: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Soft labels (obs, category, weight) with fine categories merged; unmapped ones stay. Hard labels: ``relabel``."""
    return relabel(weights, mapping).groupBy("obs", "category").agg(F.sum("weight").alias("weight"))


def relabel(labels: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    flat = inverse_mapping(mapping)
    if not flat:
        return labels
    table = F.create_map(*[F.lit(v) for kv in flat.items() for v in kv])
    return labels.withColumn("category", F.coalesce(table[F.col("category")], F.col("category")))


def argmax_label(weights: DataFrame) -> DataFrame:
    """(obs, category) of the greatest weight; the first category in order among equals."""
    return weights.filter("weight is not null").groupBy("obs").agg(F.min_by("category", F.struct(-F.col("weight"), "category")).alias("category"))


def max_annotation(weights: DataFrame, n: int = 1) -> DataFrame:
    """Only weights not below the n-th greatest of the observation (ties stay), summing to 1."""
    rank = F.rank().over(Window.partitionBy("obs").orderBy(F.desc("weight")))
    return normalise(weights.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r"), "obs", "weight")


def row_mode(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, mode): the most frequent value over the columns, nulls apart; the smallest among equals, null if there is none."""
    votes = df.select(key, F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("v")).filter("v is not null")
    best = votes.groupBy(key, "v").count().groupBy(key).agg(F.min_by("v", F.struct(-F.col("count"), "v")).alias("mode"))
    return df.select(key).distinct().join(best, key, "left")


def mixture_profiles(profiles: DataFrame, include_pure: bool = False) -> tuple[DataFrame, DataFrame]:
    """Even mixtures of all pairs of categories of profiles (var, category, p), named 'a+b', and the membership weights
    (mixture, category, weight), so that each category's sum to 1 over its mixtures."""
    cats = profiles.select("category").distinct()
    b = cats.withColumnRenamed("category", "other")
    pairs = cats.join(b, F.col("category") <= F.col("other") if include_pure else F.col("category") < F.col("other"))
    pairs = pairs.withColumn("mixture", F.concat_ws("+", "category", "other"))
    members = pairs.select("mixture", F.explode(F.array("category", "other")).alias("category"))
    half = members.groupBy("mixture", "category").agg((F.count("*") / 2).alias("half"))
    mixed = half.join(profiles, "category").groupBy("mixture", "var").agg(F.sum(F.col("half") * F.col("p")).alias("p"))
    n = half.groupBy("category").agg(F.sum("half").alias("n"))
    return mixed, half.join(n, "category").select("mixture", "category", (F.col("half") / F.col("n")).alias("weight"))


def in_ranges(df: DataFrame, by: str) -> DataFrame:
    """df sorted into ranges of a column, written once, with the range ``_p`` and the place ``_k`` in it, from 1: what needs an order
    over all rows goes range by range, and from range to range by one row each."""
    parts = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id())
    return cut(parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(by))))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Quantiles by linear interpolation between order statistics, nulls and NaN apart; none of an empty column."""
    parts = in_ranges(df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "v")
    sizes = [(r[0], r[1]) for r in parts.groupBy("_p").count().orderBy("_p").collect()]  # a row a range
    n = sum(c for _, c in sizes)
    if not n:
        return []
    places = {}
    for rank in {int(q * (n - 1)) + d for q in shares for d in (0, 1)} & set(range(n)):
        before = 0
        for p, c in sizes:
            if rank < before + c:
                places[p, rank - before + 1] = rank
                break
            before += c
    wanted = df.sparkSession.createDataFrame([(p, k, r) for (p, k), r in places.items()], "_p int, _k int, r long")
    at = {r["r"]: r["v"] for r in parts.join(F.broadcast(wanted), ["_p", "_k"]).collect()}  # two a quantile
    out = []
    for q in shares:
        h = q * (n - 1)
        low = int(h)
        out.append(at[low] + (h - low) * (at[min(low + 1, n - 1)] - at[low]))
    return out


BINS = 1024


def take_first(df: DataFrame, groups: list[str], key: str, tie: str, n: str) -> DataFrame:
    """Of each group, the ``n`` rows (a column, alike within the group) smallest by (key, tie); key lies in [0, 1).
    Counts bins of keys and sorts only the bin in which the n-th row lies."""
    binned = df.withColumn("_bin", F.floor(F.col(key) * BINS).cast("int"))
    counts = binned.groupBy(*groups, "_bin").agg(F.count("*").alias("_c"), F.first(n).alias("_n"))
    run = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = counts.withColumn("_before", run - F.col("_c")).filter(F.col("_before") < F.col("_n"))
    near = binned.join(steps.select(*groups, "_bin", "_c", "_before"), [*groups, "_bin"])
    whole = near.filter(F.col("_before") + F.col("_c") <= F.col(n))
    edge = near.filter(F.col("_before") + F.col("_c") > F.col(n))
    rank = F.row_number().over(Window.partitionBy(*groups, "_bin").orderBy(key, tie))
    edge = edge.withColumn("_r", rank).filter(F.col("_before") + F.col("_r") <= F.col(n)).drop("_r")
    return whole.unionByName(edge).drop("_bin", "_c", "_before")


def complete_choice(df: DataFrame, group: str, key: str, size: DataFrame, seed: int = 0) -> DataFrame:
    """Rows drawn from each group without replacement, ``size`` (group, n) of them; where n exceeds the group, every row comes
    in whole rounds and the remainder is drawn. Column ``draws`` says how often a row was drawn."""
    m = df.groupBy(group).agg(F.count("*").alias("_m"))
    plan = m.join(size, group).select(group, F.floor(F.col("n") / F.col("_m")).cast("long").alias("_whole"), (F.col("n") % F.col("_m")).cast("long").alias("_rest"))
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    rows = df.join(plan, group).withColumn("_u", u)
    drawn = take_first(rows.filter("_rest > 0"), [group], "_u", key, "_rest").select(group, *[c for c in df.columns if c != group], F.lit(1).cast("long").alias("draws"))
    whole = rows.filter("_whole > 0").select(group, *[c for c in df.columns if c != group], F.col("_whole").alias("draws"))
    both = drawn.unionByName(whole)
    return both.groupBy(*df.columns).agg(F.sum("draws").alias("draws"))


def integrate_mean(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Running mean of y over x by trapezoids; needs one small series."""
    w = Window.orderBy(x)
    area = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    run = F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_a", area).withColumn("_x0", F.min(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(x, y, F.try_divide(run, F.col(x) - F.col("_x0")).alias("mean"))
