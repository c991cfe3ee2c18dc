"""Enrichment tests of values in groups, with corrections for multiple testing."""

from __future__ import annotations

from collections.abc import Sequence
from math import nan, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.tests import fisher, mann_whitney, student_tail
from lodestone.operators.aggregate import contributions
from lodestone.operators.elementwise import in_ranges

DIRECTIONS = ("enriched", "purified")


def adjust(df: DataFrame, p: str, method: str = "fdr_bh", name: str = "p_adjusted", by: Sequence[str] = ()) -> DataFrame:
    """Adjusted p values over all rows, or those of equal ``by`` (a table of tests; nulls stay null): bonferroni, holm, fdr_bh or fdr_by."""
    if method not in ("bonferroni", "holm", "fdr_bh", "fdr_by"):
        raise ValueError(f"unknown correction {method!r}")
    tests = df.filter(F.col(p).isNotNull())
    if by:
        tests, group = tests.withColumn("_p", F.struct(*by)), [F.col("_p")]
        ranked = tests.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(p))).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
        ranked = ranked.withColumn("_h", F.sum(1 / F.col("_r")).over(Window.partitionBy(*group)))
    else:
        # ranks over all tests go range by range
        parts = in_ranges(tests, p)
        upto = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sizes = parts.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", upto - F.col("_c")).drop("_c")  # a row a range
        ranked = parts.join(F.broadcast(sizes), "_p").withColumn("_r", F.col("_b") + F.col("_k")).drop("_b", "_k")
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("_n"), F.sum(1 / F.col("_r")).alias("_h"))))
    v, r, n, one = F.col(p), F.col("_r"), F.col("_n"), F.lit(1.0)
    raw = {"bonferroni": v * n, "holm": v * (n - r + 1), "fdr_bh": v * n / r, "fdr_by": F.col("_h") * v * n / r}[method]
    ranked = ranked.withColumn("_q", raw)
    if method == "bonferroni":
        q = F.col("_q")
    else:
        # the greatest so far (holm), or the least from here on
        most = method == "holm"
        w = Window.partitionBy("_p").orderBy("_r" if most else F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        q = (F.max if most else F.min)("_q").over(w)
        if not by:
            across = Window.orderBy("_p" if most else F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
            other = ranked.groupBy("_p").agg((F.max if most else F.min)("_q").alias("_e")).withColumn("_o", (F.max if most else F.min)("_e").over(across)).drop("_e")  # a row a range
            ranked = ranked.join(F.broadcast(other), "_p")
            q = (F.greatest if most else F.least)(q, "_o")
    out = ranked.withColumn(name, F.least(one, q)).select(*df.columns, name)
    return out.unionByName(df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def contingency(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(value, group, a, b, c, d): 2x2 tables value/rest by group/rest on the full grid; values(obs, value), groups(obs, group)."""
    counts = values.filter("value is not null").join(groups.filter("group is not null"), "obs").groupBy("value", "group").agg(F.count("*").alias("a"))
    grid = counts.select("value").distinct().crossJoin(counts.select("group").distinct()).join(counts, ["value", "group"], "left").fillna(0, ["a"])
    by = lambda c: F.sum("a").over(Window.partitionBy(*c))
    return grid.select("value", "group", "a", (by(["value"]) - F.col("a")).alias("b"), (by(["group"]) - F.col("a")).alias("c"), (by([]) - by(["value"]) - by(["group"]) + F.col("a")).alias("d"))


def fisher_enrichment(tables: DataFrame, p_corr: str = "fdr_bh") -> DataFrame:
    """(value, group, enrichment, p, p_adjusted) of contingency tables, in both directions."""

    def tails(batches):
        for pdf in batches:
            rows = [(v, g, e, fisher(a, b, c, d, "greater" if e == "enriched" else "less")) for v, g, a, b, c, d in pdf[["value", "group", "a", "b", "c", "d"]].itertuples(index=False) for e in DIRECTIONS]
            yield pd.DataFrame(rows, columns=["value", "group", "enrichment", "p"])

    kind = {f.name: f.dataType.simpleString() for f in tables.schema}
    return adjust(tables.mapInPandas(tails, f"value {kind['value']}, group {kind['group']}, enrichment string, p double"), "p", p_corr)


def mid_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rank``: average rank within ``by``, ties sharing theirs; counts equal values first, so sorts distinct values only."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.join(n.withColumn("rank", run - (F.col("_n") - 1) / 2.0), [*by, value]).drop("_n")


def u_statistics(samples: DataFrame, reference: str | None = None) -> DataFrame:
    """(value, group, u, n1, n2, ties, mean1, var1, mean2, var2) of each group against all others, or against a reference
    group; samples(value, group, x). One pass of ranks and sums; groups without either side drop out."""
    s = samples.filter("x is not null and not isnan(x)")
    if reference is not None:
        base = s.filter(F.col("group") == reference)
        others = s.select("group").distinct().filter(F.col("group") != reference)
        s = s.filter(F.col("group") != reference).withColumn("test", F.col("group")).unionByName(base.crossJoin(F.broadcast(others.withColumnRenamed("group", "test"))))
        by = ["value", "test"]
        s = s.withColumn("own", F.col("group") == F.col("test"))
        ranked = mid_ranks(s, by, "x")
        equal = s.groupBy(*by, "x").count().groupBy(*by).agg(F.sum(F.col("count") ** 3 - F.col("count")).alias("ties"))
        x = lambda f, side: f(F.when(F.col("own") if side else ~F.col("own"), F.col("x")))
        out = ranked.groupBy(*by).agg(F.sum(F.when(F.col("own"), F.col("rank"))).alias("rs"), x(F.count, True).alias("n1"), x(F.count, False).alias("n2"), x(F.avg, True).alias("mean1"), x(F.var_samp, True).alias("var1"), x(F.avg, False).alias("mean2"), x(F.var_samp, False).alias("var2"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        out = out.join(equal, by).withColumnRenamed("test", "group")
    else:
        ranked = mid_ranks(s, ["value"], "x")
        equal = s.groupBy("value", "x").count().groupBy("value").agg(F.sum(F.col("count") ** 3 - F.col("count")).alias("ties"))
        each = ranked.groupBy("value", "group").agg(F.sum("rank").alias("rs"), F.count("*").alias("n1"), F.sum("x").alias("s1"), F.sum(F.col("x") ** 2).alias("q1"), F.min("x").alias("lo1"), F.max("x").alias("hi1"))
        w = Window.partitionBy("value")
        rest = lambda c: F.sum(c).over(w) - F.col(c)
        each = each.withColumn("n2", rest("n1")).withColumn("s2", rest("s1")).withColumn("q2", rest("q1")).withColumn("lo", F.min("lo1").over(w)).withColumn("hi", F.max("hi1").over(w))
        var = lambda k: F.try_divide(F.col(f"q{k}") - F.col(f"s{k}") ** 2 / F.col(f"n{k}"), F.col(f"n{k}") - 1)
        out = each.filter("n2 > 0").join(equal, "value").select("value", "group", "rs", "n1", "n2", "ties", (F.col("s1") / F.col("n1")).alias("mean1"), var(1).alias("var1"), (F.col("s2") / F.col("n2")).alias("mean2"), var(2).alias("var2"), "lo", "hi")
    return out.filter("n1 > 0 and n2 > 0 and lo < hi").select("value", "group", (F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "n1", "n2", "ties", "mean1", "var1", "mean2", "var2")


def enrichment(samples: DataFrame, method: str = "mwu", p_corr: str = "fdr_bh", reference: str | None = None, n_boot: int = 0) -> DataFrame:
    """(value, group, enrichment, p, p_adjusted): 'mwu', 't' (equal variances) or 'welch' tests of samples(value, group, x).
    With ``n_boot`` the sizes count as n / (1 + n_boot), for samples enlarged by that many bootstrap copies."""
    stats = u_statistics(samples, reference)

    def tail(row, sign):
        if method == "mwu":
            return mann_whitney(row.u if sign > 0 else row.n1 * row.n2 - row.u, int(row.n1), int(row.n2), row.ties)
        f = 1.0 + n_boot
        n1, n2 = row.n1 / f, row.n2 / f
        v1, v2 = (row.var1 * (row.n1 - 1) / max(row.n1 - f, 1e-12) if row.n1 > f else nan), (row.var2 * (row.n2 - 1) / max(row.n2 - f, 1e-12) if row.n2 > f else nan)
        if method == "t":
            v1 = 0.0 if n1 <= 1 else v1
            v2 = 0.0 if n2 <= 1 else v2
            df = n1 + n2 - 2
            if df <= 0:
                return nan
            pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / df
            se = sqrt(pooled * (1 / n1 + 1 / n2))
        else:
            if not (n1 > 1 and n2 > 1):
                return nan
            a, b = v1 / n1, v2 / n2
            se = sqrt(a + b)
            df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if se else nan
        if not se or se != se:
            return nan
        return student_tail(sign * (row.mean1 - row.mean2) / se, df)

    def tails(batches):
        for pdf in batches:
            rows = [(r.value, r.group, e, tail(r, s)) for r in pdf.itertuples() for e, s in zip(DIRECTIONS, (1, -1))]
            out = pd.DataFrame(rows, columns=["value", "group", "enrichment", "p"])
            out["p"] = out["p"].astype(float).replace({np.nan: None}) if len(out) else out["p"]
            yield out

    kind = {f.name: f.dataType.simpleString() for f in stats.schema}
    tested = stats.mapInPandas(tails, f"value {kind['value']}, group {kind['group']}, enrichment string, p double")
    return adjust(tested.withColumn("p", F.when(F.isnan("p"), None).otherwise(F.col("p"))), "p", p_corr)


def enrichments(values: DataFrame, groups: DataFrame, method: str = "mwu", reference_group: str | None = None, p_corr: str = "fdr_bh", n_boot: int = 0, direction: str = "both", reduction: str | None = "mean", normalization: str | None = "gmean", **kw) -> DataFrame:
    """(value, group, enrichment, p, p_adjusted): tests of every value in every group against the other groups, or a reference
    group. values(obs, category, weight) and groups(obs, group[, sample]) go through ``contributions`` (whose other options,
    such as ``positions`` with ``position_split``, ``reads`` and ``min_obs``, are passed on), so that a sample (or part of one)
    is one measurement; without samples every observation is. 'fisher' tests the numbers of observations by label and
    group instead. ``direction`` 'enriched' or 'purified' tests and corrects for one side only."""
    if direction not in ("both", *DIRECTIONS):
        raise ValueError(f"direction is 'both', 'enriched' or 'purified', not {direction!r}")
    if method == "fisher":
        tested = fisher_enrichment(contingency(values.select("obs", F.col("category").alias("value")), groups.select("obs", "group")), p_corr)
    else:
        single = "sample" not in groups.columns and not kw.get("position_split")
        c = contributions(values, groups, None if single else reduction, normalization, **kw)
        samples = c.filter("contribution is not null and not isnan(contribution)").select(F.col("value_key").alias("value"), "group", F.col("contribution").alias("x"))
        tested = enrichment(samples, method, p_corr, reference_group, n_boot)
    if direction == "both":
        return tested
    return adjust(tested.filter(F.col("enrichment") == direction).drop("p_adjusted"), "p", p_corr)


def over_representation(members: DataFrame, study: DataFrame, population: DataFrame, namespaces: DataFrame | None = None, alpha: float = 0.05, p_corr: str = "fdr_bh") -> DataFrame:
    """(term, a, n_term, p, p_adjusted): terms over-represented in study(gene) within population(gene), by Fisher's test;
    members(gene, term). Corrected over all terms, or by namespace if namespaces(term, namespace) are given; terms
    without a namespace, or with a null one, are corrected together."""
    pop = population.select("gene").distinct()
    inside = study.select("gene").distinct().join(pop, "gene", "left_semi").withColumn("hit", F.lit(1))
    totals = pop.join(inside, "gene", "left").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    per = members.distinct().join(pop, "gene", "left_semi").join(inside, "gene", "left").groupBy("term").agg(F.count("*").alias("m"), F.count("hit").alias("a"))
    t = per.filter("a > 0").crossJoin(F.broadcast(totals))

    def tails(batches):
        for pdf in batches:
            p = [fisher(int(a), int(k - a), int(m - a), int(n - m - k + a)) for a, m, n, k in zip(pdf["a"], pdf["m"], pdf["n"], pdf["k"])]
            yield pd.DataFrame({"term": pdf["term"], "a": pdf["a"], "n_term": pdf["m"], "p": p})

    out = t.mapInPandas(tails, "term string, a long, n_term long, p double")
    if namespaces is None:
        return adjust(out, "p", p_corr).filter(F.col("p_adjusted") < alpha)
    named = out.join(namespaces.select("term", "namespace"), "term", "left")
    return adjust(named, "p", p_corr, by=["namespace"]).filter(F.col("p_adjusted") < alpha)


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, mismatch) over pairs finite in both: Pearson's r and the mean squared difference over the variance of x."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return d.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"), F.try_divide(F.avg((F.col(x) - F.col(y)) ** 2), F.var_pop(x)).alias("mismatch"))
