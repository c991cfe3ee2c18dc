"""Block products, least squares by rows, tiles for nearest points, and operators beyond the sizes of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lodestone.functions.nnls import nnls, nnls_rows
from lodestone.functions.transport import fit_marginals, fit_rows
from lodestone.operators import aggregate as A
from lodestone.operators import elementwise as E
from lodestone.operators import graph, molecules
from lodestone.operators import packed
from lodestone.operators import similarity as D
from lodestone.operators import spatial as S
from lodestone.operators import stats as T


def long(spark, m, row="o"):
    return spark.createDataFrame([(f"{row}{i}", f"g{j}", float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "obs string, var string, value double")


def test_least_squares_of_many_rows_equal_single_ones():
    rng = np.random.default_rng(0)
    a, b = rng.random((30, 7)), rng.standard_normal((60, 30)) + 0.3
    got = nnls_rows(a.T @ a, b @ a)
    assert np.allclose(got, [nnls(a, r) for r in b], atol=1e-8)
    twin = np.hstack([a, a[:, :1]])  # a singular Gram matrix
    fit = nnls_rows(twin.T @ twin, b @ twin) @ twin.T
    assert np.allclose(fit, got @ a.T, atol=1e-6)
    assert nnls_rows(a.T @ a, np.zeros((0, 7))).shape == (0, 7)


def test_fits_of_many_rows_equal_single_ones():
    rng = np.random.default_rng(1)
    m, u = rng.random((6, 3)) + 0.01, rng.random((5, 6))
    v = rng.random((5, 3))
    v *= u.sum(1, keepdims=True) / v.sum(1, keepdims=True)
    a, b = fit_rows(m, u, v, 1e-10, 1000)
    for r in range(5):
        assert np.allclose(a[r][:, None] * m * b[r], fit_marginals(m, u[r], v[r], 1e-10, 1000), atol=1e-6)


@pytest.mark.parametrize("metric", D.DISTANCES)
def test_distances_of_two_large_sides(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    a, b = long(spark, rng.poisson(1.5, (9, 12))), long(spark, rng.poisson(2, (4, 12)) + 1.0, "p")
    key = lambda d: {(r["i"], r["j"]): r["distance"] for r in d.collect()}
    block = key(D.cdist(a, b, metric))
    monkeypatch.setattr(packed, "ENTRIES", 3)
    joined = key(D.cdist(a, b, metric))
    assert block.keys() == joined.keys() and all(block[k] == pytest.approx(joined[k], abs=1e-9) for k in block)


@pytest.mark.parametrize("metric", D.OVERLAPS)
def test_overlaps_of_two_large_sides(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    a, b = long(spark, rng.poisson(0.5, (9, 12))), long(spark, rng.poisson(0.7, (4, 12)), "p")
    key = lambda d: {(r["i"], r["j"]): r["value"] for r in d.collect()}
    block = key(D.overlap(a, b, metric))
    monkeypatch.setattr(packed, "ENTRIES", 3)
    joined = key(D.overlap(a, b, metric))
    assert block.keys() == joined.keys() and all(block[k] == pytest.approx(joined[k], abs=1e-9) for k in block)


def test_nearest_labelled_in_tiles(spark):
    rng = np.random.default_rng(4)
    p = [(f"q{i}", *map(float, rng.random(2) * 50), rng.choice(["a", "b"])) for i in range(80)] + [("far", 900.0, 900.0, "a"), ("none", 1.0, 1.0, "c"), ("nan", float("nan"), 1.0, "a")]
    q = [(f"r{i:03d}", *map(float, (rng.random(2) * 50).round(0)), rng.choice(["a", "b"])) for i in range(120)]
    schema = "obs string, x double, y double, g string"
    out = S.nearest_labelled(spark.createDataFrame(p, schema), spark.createDataFrame(q, schema), 4, "g", tile_points=16).collect()
    got = {}
    for r in out:
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    assert "none" not in got and "nan" not in got
    for name, x, y, g in p[:81]:
        want = sorted((np.hypot(x - a, y - b), n) for n, a, b, h in q if h == g)[:4]
        assert [j for _, j in sorted(got[name])] == [n for _, n in want], name


def test_large_components_are_halved_first(spark):
    edges = [(f"{s}{i:03d}", f"{s}{i + d:03d}", 1.0) for s in "ab" for i in range(60) for d in (1, 2) if i + d < 60] + [("a059", "b000", 0.01)]
    e = spark.createDataFrame(edges, "i string, j string, w double")
    nodes = spark.createDataFrame([(f"{s}{i:03d}",) for s in "ab" for i in range(60)], "obs string")
    c = {r["node"]: r["cluster"] for r in graph.spectral_clustering(e, nodes, largest=70, cut_threshold=0.0).collect()}
    sizes = np.unique(list(c.values()), return_counts=True)[1]
    assert len(c) == 120 and len(sizes) > 1 and sizes.max() <= 70


def test_many_components_in_few_tasks(spark, monkeypatch):
    edges = [(f"c{k:04d}n{a}", f"c{k:04d}n{b}", 0.1 if (a < 2) != (b < 2) else 1.0) for k in range(600) for a, b in ((0, 1), (2, 3), (1, 2))]
    e = spark.createDataFrame(edges, "i string, j string, w double")
    nodes = spark.createDataFrame([(f"c{k:04d}n{a}",) for k in range(600) for a in range(4)] + [("alone",)], "obs string")
    began = spark.sparkContext.accumulator(0)
    group = type(e.groupBy("i")).applyInPandas

    def counted(self, f, schema):
        def run(pdf):
            began.add(1)
            return f(pdf)

        return group(self, run, schema)

    monkeypatch.setattr(type(e.groupBy("i")), "applyInPandas", counted)
    found = graph.spectral_clustering(e, nodes)
    assert {r["node"]: r["cluster"] for r in found.collect()} == {f"c{k:04d}n{a}": f"c{k:04d}n{a - a % 2}" for k in range(600) for a in range(4)} | {"alone": "alone"}
    assert began.value < 100


@pytest.mark.parametrize("rule", [(0.7, 2, 50, 1, None, None), (0.7, 2, 20, 3, 2.5, None), (0.3, 3, None, 1, None, 2.0)])
def test_components_split_together_equal_single_ones(rule):
    rng = np.random.default_rng(6)
    threshold, dim, most, least, reach, aspect = rule
    sizes = [300, 90, *rng.integers(1, 14, 40)]
    c = rng.permutation(np.repeat(np.arange(len(sizes)), sizes))
    xy = rng.random((len(c), 2)) * np.sqrt(np.array(sizes)[c])[:, None]
    m = np.exp(-2 * ((xy[:, None] - xy) ** 2).sum(2)) * (c[:, None] == c)
    m[m < 0.01] = 0
    np.fill_diagonal(m, 0)
    i, j = np.nonzero(m)
    label = graph._bisect_all(c, i, j, m[i, j], threshold, dim, most, least, xy, reach, aspect)
    for k in range(len(sizes)):
        own = np.flatnonzero(c == k)
        want = graph._bisect(m[np.ix_(own, own)], threshold, dim, most, least, xy[own], reach, aspect)
        assert len(set(zip(want, label[own]))) == len(set(want)) == len(set(label[own]))
    assert len(set(zip(c, label))) == len(set(label))


def test_communities(spark):
    edges = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "abc" for i in range(8) for j in range(8) if i != j] + [("a0", "b0", 0.1), ("b0", "a0", 0.1), ("b1", "c1", 0.1), ("c1", "b1", 0.1)]
    nodes = spark.createDataFrame([(f"{s}{i}",) for s in "abc" for i in range(8)] + [("alone",)], "obs string")
    c = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(edges, "i string, j string, w double"), nodes).collect()}
    assert {n: c[n] for n in c} == {**{f"{s}{i}": f"{s}0" for s in "abc" for i in range(8)}, "alone": "alone"}


def test_ranks_and_quantiles_over_ranges(spark):
    rng = np.random.default_rng(5)
    p = rng.random(200).round(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(-1, None)], "k int, p double")
    got = {r["k"]: r["p_adjusted"] for r in T.adjust(df, "p", "fdr_bh").collect()}
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1].clip(max=1)
    assert all(got[int(i)] == pytest.approx(v) for i, v in zip(order, q)) and got[-1] is None
    assert np.allclose(E.quantiles(df, "p", [0, 0.25, 0.5, 1]), np.quantile(p, [0, 0.25, 0.5, 1]))
    assert E.quantiles(df.limit(0), "p", [0.5]) == []


def test_contributions_by_functions_and_zero_rules(spark):
    v = spark.createDataFrame([("o1", "A", 1.0), ("o2", "A", 3.0), ("o2", "B", 2.0), ("o3", "B", 4.0)], "obs string, category string, weight double")
    g = spark.createDataFrame([("o1", "x"), ("o2", "x"), ("o3", "y")], "obs string, group string")
    key = lambda d: {(r["group"], r["value_key"]): r["contribution"] for r in d.collect()}
    assert key(A.contributions(v, g, F.max)) == {("x", "A"): 3.0, ("x", "B"): 2.0, ("y", "A"): 0.0, ("y", "B"): 4.0}
    assert key(A.contributions(v, g, "sum", "B"))["x", "A"] == 2.0
    assert key(A.contributions(v, g, "sum", "clr", zeros="auto"))["y", "A"] == pytest.approx(-np.log(5) / 2)
    assert key(A.contributions(v, g, "sum", "gmean", zeros="small"))["y", "A"] == pytest.approx(0.002 / np.sqrt(0.002 * 4))
    assert key(A.contributions(v, g, "sum", lambda c, w: c / F.max(c).over(w)))["y", "B"] == 1.0


@pytest.mark.parametrize("shape", ["gauss", "disc", 0.1, 1.0])
def test_bead_profiles_integrate_to_their_area(shape):
    _, number, area = molecules.bead_profile(shape, 0.2)
    r = np.linspace(0, 4, 400_001)
    assert np.trapezoid(2 * np.pi * r * number(r), r) == pytest.approx(area, rel=1e-3) and number(np.array([0.0]))[0] == 1


def test_refinement_in_blocks_equals_joins(spark):
    x = spark.createDataFrame([("a", "g1", 3.0), ("a", "g2", 1.5), ("b", "g2", 70000.0), ("b", "g3", 2.0), ("c", "g3", 4.0), (None, "g1", 1.0)], "obs string, var string, value double")
    w = spark.createDataFrame([("a", "A", 0.7), ("a", "B", 0.3), ("b", "B", 1.0), ("b", "Z", 1.0), ("c", "A", 0.0)], "obs string, category string, weight double")
    p = A.soft_profiles(x, w).filter("category <> 'Z'")
    key = lambda d: {r[:2]: r[2] for r in map(tuple, d.collect())}
    for got, want in zip(A.refine_reference(x, w, p), A._refined_by_joins(x.filter("obs is not null"), w, p, 1e-3)):
        assert key(got) == pytest.approx(key(want))
    repeated = x.unionByName(spark.createDataFrame([("a", "g1", 2.0)], x.schema)).filter("obs is not null")
    hard = spark.createDataFrame([("a", "A"), ("b", "B")], "obs string, category string")
    soft = spark.createDataFrame([(o, c, 0.9 if (o == "a") == (c == "A") else 0.1) for o in "ab" for c in "AB"], "obs string, category string, weight double")
    for got, want in zip(A.refine_labelled(repeated, hard, 0.9, 0.1), A._refined_by_joins(x, soft, A.reference_profiles(x, hard), 1e-3)):
        assert key(got) == pytest.approx(key(want))


def test_refinement_shuffles_no_entry_by_category(spark):
    d, sc = "/root/testdata/sf0.001", spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    assert queries()["refine_reference"](spark, d).count() == 1152
    assert shuffled() - before < spark.read.parquet(f"{d}/counts.parquet").count()


@pytest.mark.parametrize("method", ["projection", "nnls"])
def test_molecules_in_tiles_equal_those_by_shifts(spark, monkeypatch, method):
    monkeypatch.setattr(molecules, "TILE", 4)
    rng = np.random.default_rng(7)
    mine = [(f"m{i}", *map(float, rng.random(2) * 100), f"g{rng.integers(7)}") for i in range(900)]
    m = spark.createDataFrame([*mine, ("far", 2000.0, 5.0, "g1"), ("lost", None, 5.0, "g1"), ("bare", 5.0, 5.0, None)], "obs string, x double, y double, gene string")
    reference = long(spark, rng.poisson(3 * rng.random((3, 6))[np.arange(30) % 3]))
    labels = spark.createDataFrame([(f"o{i}", "ABC"[i % 3]) for i in range(30)], "obs string, category string")
    kw = {"deconvolution": False} if method == "projection" else {}
    tiled = molecules._in_tiles(m, reference, labels, 12.0, 2, method, kw)
    assert tiled is not None and molecules._in_tiles(m, reference, labels, 12.0, 2, "OT", {}) is None
    got, want = ({r["obs"]: r["category"] for r in d.collect()} for d in (tiled, molecules._by_shifts(m.filter("x is not null and gene is not null"), reference, labels, 12.0, 2, method, **kw)))
    assert got == want | {"lost": None, "bare": None} and tiled.count() == 903
