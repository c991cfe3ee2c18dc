"""Mixture of sources to target shares of the total size, with capped repetition.

Every source has a budget, its target weight times the total. Whole epochs of a source come first, as many as the
budget and the cap on repeats allow; what is then left of the budget is filled with documents in the order of
Efraimidis-Spirakis keys, -ln(u) / weight with u from a hash of identifier and seed, as long as their prefix sum stays
within it. The prefix sum is taken over bins of keys; only the bin in which a budget ends is summed row by row, so
a source that holds most rows isn't sorted in one task.

Defined results: documents with a null identifier, null source, or no size take no part, nor do sources that aren't
in the list (they do count in the default total). Quality weights that are null, not finite or not positive count as
1e-6. Sources listed twice count once, by the largest weight. Repeated identifiers are separate documents. A source
without documents gives nothing and is reported. Equal keys are taken in the order of identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import cut

BINS = 4096


def mix(documents: DataFrame, weights: DataFrame, identifier: str, source: str, size: str, quality: str | None = None, total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((identifier, source, uses), report); weights has source, target_weight, max_repeats. Total: by default the size
    of all documents that have a source. The report has for each listed source: available, budget, used, target_weight,
    actual_share (of what was used), short (whether every use of every document is in the mixture and the budget still isn't met)."""
    w = F.col(f"`{quality}`").cast("double") if quality else F.lit(1.0)
    docs = documents.select(F.col(f"`{identifier}`").alias("i"), F.col(f"`{source}`").cast("string").alias("s"), F.col(f"`{size}`").cast("long").alias("n"), w.alias("w"))
    docs = cut(docs.filter("i is not null and s is not null and n > 0").withColumn("w", F.when(F.col("w").between(1e-6, 1e300), F.col("w")).otherwise(1e-6)))
    have = docs.groupBy("s").agg(F.sum("n").alias("available"), F.avg("w").alias("mean_w"))
    listed = weights.select(F.col("source").cast("string").alias("s"), F.coalesce(F.col("target_weight").cast("double"), F.lit(0.0)).alias("target_weight"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeats").cast("long"), F.lit(0))).alias("max_repeats")).filter("s is not null").groupBy("s").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    all_of_it = F.lit(float(total)).alias("total") if total is not None else F.coalesce(F.sum("available").cast("double"), F.lit(0.0)).alias("total")
    plan = listed.join(have, "s", "left").crossJoin(have.agg(all_of_it))
    plan = plan.fillna(0, ["available"]).fillna(1.0, ["mean_w"]).withColumn("budget", F.col("target_weight") * F.col("total"))
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.least("max_repeats", F.floor(F.col("budget") / F.col("available")))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)))
    # keys, and their bins: 1 - exp(-key) is uniform where all weights are alike
    u = (F.pmod(F.xxhash64("i", F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    keyed = docs.join(plan.select("s", "mean_w", "epochs", "rest"), "s").withColumn("key", -F.log(u) / (F.col("w") / F.col("mean_w")))
    keyed = keyed.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-F.col("key"))) * BINS)).cast("int"))
    bins = keyed.groupBy("s", "bin").agg(F.sum("n").alias("m"), F.first("rest").alias("rest"))
    run = F.sum("m").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = cut(bins.withColumn("run", run).filter(F.col("run") > F.col("rest")).groupBy("s").agg(F.min(F.struct("bin", (F.col("run") - F.col("m")).alias("before"))).alias("e")).select("s", "e.bin", "e.before"))
    at = edge.select("s", F.col("bin").alias("edge"), F.col("before"))
    marked = keyed.join(at, "s", "left")
    inner = F.sum("n").over(Window.partitionBy("s", "bin").orderBy("key", F.col("i").cast("string")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on_edge = marked.filter(F.col("bin") == F.col("edge")).withColumn("taken", F.col("before") + inner <= F.col("rest"))
    off_edge = marked.filter(F.col("edge").isNull() | (F.col("bin") != F.col("edge"))).withColumn("taken", F.col("edge").isNull() | (F.col("bin") < F.col("edge")))
    used = on_edge.unionByName(off_edge).withColumn("uses", (F.col("epochs") + F.col("taken").cast("long")).cast("int"))
    chosen = cut(used.filter("uses > 0").select(F.col("i").alias(identifier), F.col("s").alias(source), F.col("n"), "uses"))
    got = chosen.groupBy(F.col(f"`{source}`").alias("s")).agg(F.sum(F.col("n") * F.col("uses")).alias("used"))
    report = plan.join(got, "s", "left").fillna(0, ["used"])
    report = report.crossJoin(got.agg(F.sum("used").alias("mixed"))).select(F.col("s").alias("source"), "available", "max_repeats", "budget", "used", "target_weight", F.try_divide(F.col("used"), F.col("mixed")).alias("actual_share"), ((F.col("used") == F.col("available") * F.col("max_repeats")) & (F.col("used") < F.col("budget"))).alias("short"))
    return chosen.select(f"`{identifier}`", f"`{source}`", "uses"), report
