"""A sample whose share of each category matches target proportions, with minimums, by swap repair.

Records are grouped by their signature (the categories they have in all attributes with targets). For each draw the
search works on counts of signatures: it starts from a random sample that satisfies the floors where it can, then
moves records from one signature to another, in steps halving down to one, as long as that lowers the squared
deviation from the wanted counts, and ends when no exchange does. The counts are then materialised: the records with
the smallest hashes of (draw, identifier) within their signature. What a draw's task holds is one row for each signature.

Wanted of a category: the greater of its minimum and floor(share * size + 0.5). Defined results: null identifiers,
samples and signatures take no part, nor do records without any category. A repeated target row
counts once, the greatest values among unequal ones; null shares, sizes and minimums are 0. A draw whose population is
empty is reported with nothing drawn. A draw never takes a record twice; a category with too few records gives all it has.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut, partitions

BINS = 1024


def canonical(labels: DataFrame, column: str, names: DataFrame, name: str, plain) -> DataFrame:
    """``labels`` with ``column`` replaced by the name it equals in plain spelling or, failing that, is the beginning of,
    if it is so of one name only; null if there is none."""
    spelled = names.select(F.col(name).alias("_name"), plain(F.col(name)).alias("_p")).filter("_p is not null").groupBy("_p").agg(F.min("_name").alias("_name"))
    cuts = spelled.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("_p")), lambda n: F.substring("_p", F.lit(1), n))).alias("_p"), F.lit(0).alias("_whole"))
    cuts = cuts.groupBy("_p").agg(F.min("_name").alias("_cut"), F.count("*").alias("_n")).filter("_n = 1")
    key = plain(F.col(column))
    out = labels.withColumn("_p", key).join(spelled, "_p", "left").join(cuts.select("_p", "_cut"), "_p", "left")
    return out.withColumn(column, F.coalesce("_name", "_cut")).drop("_p", "_name", "_cut")


def take_first(df: DataFrame, groups: list[str], key: str, tie: str, n: str) -> DataFrame:
    """Of each group, the ``n`` rows (a column, alike within the group) smallest by (key, tie); key lies in [0, 1).
    Counts bins of keys and sorts only the bin in which the n-th row lies."""
    binned = df.withColumn("_bin", F.floor(F.col(key) * BINS).cast("int"))
    counts = binned.groupBy(*groups, "_bin").agg(F.count("*").alias("_m"), F.first(n).alias("_n"))
    run = F.sum("_m").over(Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = counts.withColumn("_before", run - F.col("_m")).filter(F.col("_before") < F.col("_n"))
    near = binned.join(steps.select(*groups, "_bin", "_m", "_before"), [*groups, "_bin"])
    all_of_it = near.filter(F.col("_before") + F.col("_m") <= F.col(n))
    edge = near.filter(F.col("_before") + F.col("_m") > F.col(n))
    rank = F.row_number().over(Window.partitionBy(*groups, "_bin").orderBy(key, tie))
    edge = edge.withColumn("_r", rank).filter(F.col("_before") + F.col("_r") <= F.col(n)).drop("_r")
    return all_of_it.unionByName(edge).drop("_bin", "_m", "_before")


def repair(member: np.ndarray, available: np.ndarray, wanted: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Counts of signatures; member[s, c] says whether signature s has category c."""
    rng = np.random.default_rng(seed)
    count = np.zeros(len(available), np.int64)
    if not len(available):
        return count
    for c in rng.permutation(member.shape[1]):  # floors, from random records of the category
        mine = np.flatnonzero(member[:, c])
        short = int(min(floor[c], available[mine].sum()) - count[mine].sum())
        if short > 0:
            count[mine] += rng.multivariate_hypergeometric(available[mine] - count[mine], short, method="marginals")
    size = min(max(size, int(count.sum())), int(available.sum()))
    if size > count.sum():
        count += rng.multivariate_hypergeometric(available - count, int(size - count.sum()), method="marginals")
    m = member.astype(float)
    overlap = m @ m.T
    own = np.diag(overlap)
    # a move of h records from s to t changes the squared deviation by 2h(g[t] - g[s]) + h^2 |m[t] - m[s]|^2
    apart = own[:, None] + own[None] - 2 * overlap
    step = 1 << max(0, int(size).bit_length() - 1)
    while step:
        g = m @ (count @ m - wanted)
        change = 2 * step * (g[None, :] - g[:, None]) + step * step * apart
        held = count @ m
        change[(count < step), :] = np.inf
        change[:, (available - count) < step] = np.inf
        # no move may break a floor that holds
        tight = (held - step < np.minimum(floor, held)) & (floor > 0)
        change[(m * tight) @ (1 - m).T > 0] = np.inf
        s, t = np.unravel_index(int(change.argmin()), change.shape)
        if change[s, t] < -1e-9:
            count[s] -= step
            count[t] += step
        else:
            step //= 2
    return count


def draw(records: DataFrame, targets: DataFrame, attributes: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """records(i, sample, *attributes); targets(draw, sample, attribute, category, share, size, minimum).
    Returns ((draw, i), report(draw, attribute, category, wanted, available, drawn, share, actual_share, missed, short)):
    ``missed`` where fewer were drawn than wanted for whatever reason, ``short`` where that is for want of records."""
    targets = targets.filter("draw is not null and category is not null").groupBy("draw", "attribute", "category").agg(*[F.max(c).alias(c) for c in ("sample",)], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("share", "size", "minimum")])
    targets = cut(targets.withColumn("wanted", F.greatest(F.col("minimum").cast("long"), F.floor(F.col("share") * F.col("size") + 0.5).cast("long"))))
    records = records.filter("i is not null and sample is not null").withColumn("sig", F.array(*[F.coalesce(F.concat(F.lit(a + "="), F.col(f"`{a}`").cast("string")), F.lit("")) for a in attributes])).filter(F.exists("sig", lambda e: e != "")).select("i", "sample", "sig").distinct()
    strata = cut(records.groupBy("sample", "sig").agg(F.count("*").alias("available")))
    draws = targets.groupBy("draw", "sample").agg(F.max("size").alias("size"), F.collect_list(F.struct("attribute", "category", "wanted", "minimum")).alias("goals"))
    # a draw's population: signatures of its sample, a row each
    inputs = draws.join(strata, "sample", "left")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        goals = pdf["goals"].iloc[0]
        names = [f"{g['attribute']}={g['category']}" for g in goals]
        pdf = pdf[pdf["available"].notna()]
        member = np.array([[n in set(s) for n in names] for s in pdf["sig"]], bool).reshape(len(pdf), len(names))
        number = crc32(str(pdf["draw"].iloc[0]).encode()) if len(pdf) else 0
        count = repair(member, pdf["available"].to_numpy(np.int64), np.array([g["wanted"] for g in goals], float), np.array([g["minimum"] or 0 for g in goals], np.int64), int(pdf["size"].iloc[0]) if len(pdf) else 0, seed ^ number)
        return pd.DataFrame({"draw": pdf["draw"], "sample": pdf["sample"], "sig": pdf["sig"], "available": pdf["available"], "n": count})

    kind = targets.schema["draw"].dataType.simpleString()
    inputs = inputs.repartition(partitions(records.sparkSession), "draw")  # draws are few bytes, but work
    counts = cut(inputs.groupBy("draw").applyInPandas(plan, f"draw {kind}, sample string, sig array<string>, available long, n long"))
    pool = records.join(counts.filter("n > 0").select("draw", "sample", "sig", "n"), ["sample", "sig"])
    pool = pool.withColumn("u", F.pmod(F.xxhash64("i", "draw", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    # the report counts the materialised sample
    sample = cut(take_first(pool, ["draw", "sig"], "u", "i", "n").select("draw", "i", "sig"))
    taken = sample.groupBy("draw", "sig").agg(F.count("*").alias("n"))
    by = lambda d, c, name: d.withColumn("e", F.explode("sig")).filter("e <> ''").groupBy("draw", "e").agg(F.sum(c).alias(name))
    each = by(counts, "available", "available").join(by(taken, "n", "drawn"), ["draw", "e"], "left")
    total = taken.groupBy("draw").agg(F.sum("n").alias("total"))
    report = targets.withColumn("e", F.concat_ws("=", "attribute", "category")).join(each, ["draw", "e"], "left").join(total, "draw", "left").fillna(0, ["available", "drawn"])
    report = report.select("draw", "attribute", "category", "wanted", "available", "drawn", "share", F.try_divide(F.col("drawn"), F.col("total")).alias("actual_share"), (F.col("drawn") < F.col("wanted")).alias("missed"), ((F.col("drawn") < F.col("wanted")) & (F.col("available") < F.col("wanted"))).alias("short"))
    return sample.drop("sig"), report
