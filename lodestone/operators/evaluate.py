"""Errors of soft labels against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.elementwise import argmax_label


def annotation_error(result: DataFrame, truth: DataFrame, p: float = 2.0) -> DataFrame:
    """One row (lp, projection, max_correct, corr): mean norm of the difference, mean cosine, share of equal strongest labels,
    Pearson correlation over all weights."""
    cats = truth.select("category").union(result.select("category")).distinct()
    obs = truth.select("obs").distinct()
    grid = obs.crossJoin(F.broadcast(cats)).join(result.withColumnRenamed("weight", "a"), ["obs", "category"], "left").join(truth.withColumnRenamed("weight", "b"), ["obs", "category"], "left").fillna(0.0)  # few categories
    rows = grid.groupBy("obs").agg(F.pow(F.sum(F.pow(F.abs(F.col("a") - F.col("b")), F.lit(p))), F.lit(1 / p)).alias("lp"), F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("cos"))
    hit = argmax_label(result).withColumnRenamed("category", "ca").join(argmax_label(truth).withColumnRenamed("category", "cb"), "obs")
    return rows.agg(F.avg("lp").alias("lp"), F.avg("cos").alias("projection")).crossJoin(hit.agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("max_correct"))).crossJoin(grid.agg(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("corr")))
