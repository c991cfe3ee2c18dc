"""Operators on inputs beyond the sizes at which they change their way."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lodestone.frame import clean_counts
from lodestone.operators.aggregate import category_priors, reference_profiles
from lodestone.operators.similarity import cdist
from lodestone.functions.transport import sinkhorn
from lodestone.operators import annotate as N
from lodestone.operators import stats as T
from lodestone.plans.space import _halves, points


def test_sub_clusters_of_all_observations(spark):
    rows = [(f"o{i}", f"g{j}", float(10 * (j // 2 == i % 2) + 1 + (i * j) % 3)) for i in range(60) for j in range(4)]
    reference = spark.createDataFrame(rows, "obs string, var string, value double")
    labels = spark.createDataFrame([(f"o{i}", "A") for i in range(60)], "obs string, category string")
    subs = {r["obs"]: r["sub"] for r in N.multi_center(labels, reference, 2, seeds=20).collect()}
    assert len(subs) == 60  # not only the 20 that centres come from
    assert len({subs[f"o{i}"] for i in range(0, 60, 2)}) == len({subs[f"o{i}"] for i in range(1, 60, 2)}) == 1
    assert subs["o0"] != subs["o1"]


def test_molecules_of_all_sections(spark):
    d = "/root/testdata/sf0.001"
    p = points(spark, d)
    assert p.select("sample", "section").distinct().count() > 1
    expected = clean_counts(spark, d).join(p.select("obs"), "obs").agg(F.sum(F.floor("value"))).first()[0]
    found = queries()["annotate_molecules"](spark, d)
    assert found.count() == found.select("obs").distinct().count() == expected


def test_transport_converges(spark):
    x, reference, labels = _halves(spark, "/root/testdata/sf0.001")
    profiles, priors = reference_profiles(reference, labels).localCheckpoint(), category_priors(reference, labels.withColumn("weight", F.lit(1.0))).localCheckpoint()
    x = x.localCheckpoint()
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = {(r["obs"], r["category"]): r["weight"] for r in N.annotate_ot(x, profiles, priors).collect()}
    p = profiles.select(F.col("category").alias("obs"), "var", F.col("p").alias("value"))
    cost = cdist(x, p, "h2").toPandas().pivot(index="i", columns="j", values="distance")
    a = x.groupBy("obs").agg(F.sum("value").alias("n")).toPandas().set_index("obs")["n"].loc[cost.index]
    b = priors.toPandas().set_index("category")["prior"].loc[cost.columns]
    want = sinkhorn((a / a.sum()).to_numpy(), (b / b.sum()).to_numpy(), cost.to_numpy() / cost.to_numpy().max(), 5e-3, lambda_b=0.1, rounds=5000, stop=1e-12)
    want /= want.sum(1, keepdims=True)
    for i, o in enumerate(cost.index):
        for j, c in enumerate(cost.columns):
            assert abs(got.get((o, c), 0.0) - want[i, j]) < 1e-6
    with pytest.warns(UserWarning, match="still moved"):
        N.annotate_ot(x, profiles, priors, rounds=2)


def test_over_representation_of_many_namespaces(spark):
    genes = spark.range(300).select(F.format_string("g%d", "id").alias("gene"))
    members = spark.range(300).select(F.format_string("g%d", "id").alias("gene"), F.format_string("t%d", F.col("id") % 150).alias("term"))
    namespaces = spark.range(149).select(F.format_string("t%d", "id").alias("term"), F.when(F.col("id") > 0, F.format_string("n%d", "id")).alias("namespace"))
    got = T.over_representation(members, genes, genes, namespaces, alpha=1.1).collect()
    assert {r["term"] for r in got} == {f"t{k}" for k in range(150)} and len(got) == 150
    assert all(r["p_adjusted"] == pytest.approx(r["p"]) for r in got)
