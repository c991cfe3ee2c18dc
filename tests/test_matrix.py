import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.frame import AnnotatedFrame, one_hot, unused_key
from lodestone.functions import tests as tails
from lodestone.functions.nnls import nnls
from lodestone.functions.transport import fit_marginals, kmeans, minimal_transitions, nmf, sinkhorn
from lodestone.operators import aggregate as A
from lodestone.operators import annotate as N
from lodestone.operators import cooccurrence as C
from lodestone.operators import elementwise as E
from lodestone.operators import graph, orthology, platform, qc, split
from lodestone.operators import similarity as D
from lodestone.operators import spatial as S
from lodestone.operators import stats as T
from lodestone.operators.evaluate import annotation_error
from lodestone.operators.molecules import distribute_molecules
from lodestone.sources.files import read_frame, read_tsv, write_frame, write_tsv


def long(spark, m, row="o", col="g"):
    return spark.createDataFrame([(f"{row}{i}", f"{col}{j}", float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "obs string, var string, value double")


def table(df, *keys):
    value = [c for c in df.columns if c not in keys]
    return {tuple(r[k] for k in keys): (r[value[0]] if len(value) == 1 else tuple(r[v] for v in value)) for r in df.collect()}


@pytest.fixture(scope="module")
def pure(spark):
    """Reference of three pure types, data of pure and mixed observations."""
    ref = long(spark, [np.eye(3)[t] * k for t in range(3) for k in (1, 2, 3)], "r")
    labels = spark.createDataFrame([(f"r{i}", f"t{i // 3}") for i in range(9)], "obs string, category string")
    data = long(spark, [*[np.eye(3)[t] for t in range(3) for _ in range(3)], *[[1, 1, 0]] * 3])
    return data, ref, labels


@pytest.mark.parametrize("method", ["nnls", "projection", "OT", "NMFreg"])
def test_annotation_of_pure_and_mixed(spark, pure, method):
    got = table(N.annotate(*pure, method, **({"k": 3} if method == "NMFreg" else {})), "obs", "category")
    for i in range(9):
        assert got[f"o{i}", f"t{i // 3}"] == pytest.approx(1, abs=0.03)
    for i in range(9, 12):
        assert got[f"o{i}", "t0"] == pytest.approx(0.5, abs=0.03) and got[f"o{i}", "t1"] == pytest.approx(0.5, abs=0.03)


def test_annotation_wrappers(spark, pure):
    for kw in ({"bisections": 1}, {"multi_centers": 2}, {"platform_iterations": 0}):
        got = table(N.annotate(*pure, "nnls", **kw), "obs", "category")
        assert got["o0", "t0"] == pytest.approx(1, abs=0.05) and got["o10", "t1"] == pytest.approx(0.5, abs=0.1)
    top = table(N.annotate(*pure, "nnls", max_annotation=1), "obs", "category")
    assert top["o4", "t1"] == 1
    assert table(N.annotate(*pure, "svm"), "obs", "category")["o7", "t2"] == 1
    with pytest.raises(NotImplementedError):
        N.annotate(*pure, "RCTD")


def test_single_mixture(spark):
    ref, labels = long(spark, [[10, 0, 0], [0, 20, 10]], "r"), spark.createDataFrame([("r0", "a"), ("r1", "b")], "obs string, category string")
    p = table(A.reference_profiles(ref, labels), "var", "category")
    assert p["g1", "b"] == pytest.approx(2 / 3) and p["g0", "a"] == 1
    got = table(N.annotate(long(spark, [[3, 2, 1]]), ref, labels, "nnls"), "obs", "category")
    assert got["o0", "a"] == pytest.approx(0.5) and got["o0", "b"] == pytest.approx(0.5)


def test_split_keeps_totals(spark):
    data = long(spark, [[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 3], [1, 1, 0, 1], [1, 0, 1, 3], [0, 1, 1, 4], [0, 1, 1, 5]])
    prof = spark.createDataFrame([("g0", "c0", 1.0), ("g1", "c1", 0.5), ("g3", "c1", 0.5), ("g2", "c2", 0.25), ("g3", "c2", 0.75)], "var string, category string, p double")
    w = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1 / 3, 2 / 3, 0], [0.2, 0, 0.8], [0, 1 / 3, 2 / 3], [0, 1 / 3, 2 / 3]]
    soft = spark.createDataFrame([(f"o{i}", f"c{j}", float(v)) for i, r in enumerate(w) for j, v in enumerate(r) if v], "obs string, category string, weight double")
    out = split.split_observations(data, soft, prof)
    assert out.select("obs", "category").distinct().count() == 11
    assert table(out.groupBy("obs", "var").agg(F.sum("value")), "obs", "var") == table(data, "obs", "var")
    den = table(split.split_observations(data, soft, prof, "denoise").filter("obs = 'o6'"), "category", "var", "obs")
    assert den["c1", "g1", "o6"] == pytest.approx(7 / 6) and den["c2", "g3", "o6"] == pytest.approx(3.5)
    bulk = table(split.split_observations(data, soft, prof, "bulk").filter("obs = 'o6'").select("var", "value"), "var")
    assert bulk["g3",] == pytest.approx(14 / 3)
    fractions = split.split_exact(data, soft, prof, seed=None)
    assert table(fractions.groupBy("obs", "var").agg(F.round(F.sum("value"), 9)), "obs", "var") == table(data, "obs", "var")


def test_hand_out(spark):
    rows = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "k")], "obs string, cell string")
    n = spark.createDataFrame([("h", "x", 2), ("h", "y", 1)], "cell string, category string, n long")
    assert table(split.hand_out(rows, n, "cell", "obs").select("obs", "category"), "obs") == {("a",): "x", ("b",): "x", ("c",): "y", ("d",): None}


def test_metrics(spark):
    x = long(spark, [[0, 0, 1, 0], [2, 0, 0, 0], [0, 1, 0, 0]])
    e = table(D.cdist(x, x, "euclidean"), "i", "j")
    assert e["o0", "o1"] == pytest.approx(math.sqrt(5)) and e["o0", "o2"] == pytest.approx(math.sqrt(2)) and e["o1", "o1"] == 0
    for m in ("cosine", "projection", "bc", "bc2", "hellinger"):
        d = table(D.cdist(x, x, m), "i", "j")
        assert d["o0", "o0"] == pytest.approx(0, abs=1e-7) and d["o0", "o1"] == 1
    y = long(spark, [[1, 1], [1, 3]])
    kl = table(D.cdist(y, y, "kl"), "i", "j")
    assert kl["o0", "o1"] == pytest.approx(0.5 * math.log(0.25) + 0.5 * math.log(0.75) - math.log(0.5))


def test_distance_affinity_and_annotation(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 0.0), ("c", 0.0, 4.0)], "obs string, x double, y double")
    d = S.sparse_distances(p, 10.0)
    assert sorted(set(table(d, "i", "j").values())) == [3, 4, 5]
    w = table(S.affinity(d, 2.0), "i", "j")
    assert w["a", "b"] == pytest.approx(math.exp(-9 / 8)) and w["b", "c"] == pytest.approx(math.exp(-25 / 8))
    lab = spark.createDataFrame([("a", "0"), ("b", "0"), ("c", "1")], "obs string, category string")
    a = table(S.with_annotation(d, lab, 3.0), "i", "j")
    assert a["a", "b"] == 3 and a["a", "c"] == 5
    assert table(S.dense_distances(p, p), "i", "j")["b", "c"] == 5


def co_points(spark):
    xs, ys, c = (0, 0, 1, 1, 0, 0, 1, 1, 0, 0), (0, 1, 0, 1, 10, 11, 10, 11, 30, 31), (0, 0, 1, 1, 2, 2, 1, 1, 3, 3)
    p = spark.createDataFrame([(f"o{i}", "s", float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))], "obs string, sample string, x double, y double")
    lab = spark.createDataFrame([(f"o{i}", str(v), 1.0) for i, v in enumerate(c)], "obs string, category string, weight double")
    cen = spark.createDataFrame([(f"o{i}", str(v), 1.0) for i, v in enumerate(xs)], "obs string, category string, weight double")
    return p, lab, cen


def test_co_occurrence(spark):
    p, lab, cen = co_points(spark)
    t = {(r["annotation"], r["center"], r["k"]): r for r in C.co_occurrence(p, lab, 32.0, 17.0, cen).filter("sample = 's'").collect()}
    assert [[t["0", c, k]["c"] for k in (0, 1)] for c in "01"] == [[6, 10], [8, 4]] or t["0", "0", 0]["lo"] == 0
    assert t["0", "0", 0]["hi"] == 15 and t["0", "0", 1]["hi"] == 32
    for k in (0, 1):
        for c in "01":
            assert sum(t[a, c, k]["composition"] for a in "0123") == pytest.approx(1)


def test_annotation_coordinate(spark):
    p, lab, _ = co_points(spark)
    t = table(C.annotation_coordinate(p, lab, 1.0, 40.0, 1.0), "obs", "category")
    assert t["o0", "0"] == 1.5 and t["o0", "2"] == 11.5 and t["o8", "3"] == 1.5


def test_bins_codes_cuts(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, 11.0), ("d", 101.0, 12.0), ("e", 102.0, 101.0), ("f", 103.0, 102.0)], "obs string, x double, y double")
    b = S.bin_points(p, 10.0)
    assert [r["x_bin"] for r in b.orderBy("obs").collect()] == [0, 0, 0, 10, 10, 10]
    assert [r["y_bin"] for r in b.orderBy("obs").collect()] == [0, 0, 1, 1, 10, 10]
    assert [r["code"] for r in S.codes(b, ["x_bin", "y_bin"]).orderBy("obs").collect()] == [0, 0, 1, 2, 3, 3]
    q = spark.createDataFrame([(f"o{i}", float(x), float(y)) for x in range(0, 60, 10) for y in (0, 1) for i in [x + y]], "obs string, x double, y double")
    assert [r["interval"] for r in S.balanced_cuts(q, "x", 2, None, 25.0).orderBy("x", "y").collect()] == [0, 0, 0, 0] + [None] * 4 + [1, 1, 1, 1]
    out = S.split_spatial_samples(q.withColumn("sample", F.lit("s")), [("x", 2)], "sample", 5.0)
    assert {r["label"] for r in out.collect()} == {"s|0", "s|1"}


def test_regions_and_components(spark):
    p = spark.createDataFrame([(f"o{i}", float(i), 0.0, r) for i, r in enumerate([None, None, "0", "1", "1", None])], "obs string, x double, y double, region string")
    assert [r["region"] for r in S.fill_regions(p, 1).orderBy("obs").collect()] == ["0", "0", "0", "1", "1", "1"]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "x")], "i string, j string")
    assert table(graph.connected_components(e), "node") == {("a",): "a", ("b",): "a", ("c",): "a", ("d",): "d", ("e",): "d", ("f",): "d", ("g",): "d", ("x",): "x"}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "i string, j string")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {"n000"}
    rng = np.random.default_rng(0)
    pts = [(f"{b}{i:02}", *(rng.random(2) * 10 + 100 * np.array([b % 2, b // 2]))) for b in range(4) for i in range(15)]
    pp = spark.createDataFrame([(n, float(x), float(y)) for n, x, y in pts], "obs string, x double, y double")
    seg = table(graph.segment(pp, 20.0, None), "node")
    assert len({v for v in seg.values()}) == 4 and all(v[0] == k[0][0] for k, v in seg.items())


def test_statistics(spark):
    g = spark.createDataFrame([(f"o{i}", v) for i, v in enumerate("00111")], "obs string, group string")
    v = spark.createDataFrame([(f"o{i}", c) for i, c in enumerate("55666")], "obs string, value string")
    p = table(T.fisher_enrichment(T.contingency(v, g)).drop("p_adjusted"), "value", "group", "enrichment")
    assert p["5", "0", "enriched"] == pytest.approx(0.1) and p["5", "0", "purified"] == pytest.approx(1) and p["5", "1", "enriched"] == pytest.approx(1) and p["5", "1", "purified"] == pytest.approx(0.1)
    q = table(T.fisher_enrichment(T.contingency(v, g)).select("value", "group", "enrichment", "p_adjusted"), "value", "group", "enrichment")
    assert q["6", "1", "enriched"] == pytest.approx(0.2)
    s = spark.createDataFrame([("c", "a", x) for x in (5.0, 5.5)] + [("c", "b", x) for x in (6.0, 7.0, 8.0)], "value string, group string, x double")
    m = table(T.enrichment(s).drop("p_adjusted"), "value", "group", "enrichment")
    assert m["c", "b", "enriched"] == pytest.approx(0.1) and m["c", "a", "purified"] == pytest.approx(0.1)
    assert T.enrichment(s.withColumn("x", F.lit(1.0))).count() == 0
    assert tails.student_tail(2.0, 5) == pytest.approx(0.0509697, abs=1e-6)
    assert tails.fisher(3, 1, 1, 3, "two-sided") == pytest.approx(0.4857142857)
    assert sum(tails.rank_sum_counts(3, 4)) == math.comb(7, 3)
    w = table(T.enrichment(s, "welch").drop("p_adjusted"), "value", "group", "enrichment")
    assert 0 < w["c", "b", "enriched"] < 0.05


def test_kernels():
    rng = np.random.default_rng(0)
    a = rng.random((20, 5))
    w = np.array([0.0, 1.0, 0.0, 2.0, 0.5])
    assert np.allclose(nnls(a, a @ w), w, atol=1e-6)
    assert (nnls(a, -a @ w) == 0).all()
    plan = sinkhorn(np.full(4, 0.25), np.full(4, 0.25), 1 - np.eye(4), 0.05)
    assert np.allclose(plan, np.eye(4) / 4, atol=1e-6)
    x = fit_marginals(rng.random((3, 4)) + 0.1, np.array([1.0, 2, 3]), np.array([1.5, 1.5, 1.5, 1.5]))
    assert np.allclose(x.sum(1), [1, 2, 3], atol=1e-3) and np.allclose(x.sum(0), 1.5, atol=1e-3)
    t = minimal_transitions(np.array([0.5, 0.5, 0.0]), np.array([0.5, 0.2, 0.3]))
    assert np.allclose(t.sum(1), [0.5, 0.5, 0]) and t[1, 2] == pytest.approx(0.3)
    m = rng.random((30, 2)) @ rng.random((2, 8))
    f, h = nmf(m, 2, 500)
    assert np.abs(f @ h - m).max() < 0.05
    assert len(set(kmeans(np.vstack([np.zeros((5, 2)), np.ones((5, 2))]), 2)[:5])) == 1
    true = np.array([2.17, 0.88, 3.43])
    pa = np.eye(3) + 0.1
    g = platform.rescaling_factors(pa, pa * true)
    assert np.allclose(g / g[0], true / true[0], atol=1e-3)


def test_elementwise(spark):
    w = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "y", -1.0), ("b", "z", 2.0)], "obs string, category string, weight double")
    assert table(E.argmax_label(w), "obs") == {("a",): "x", ("b",): "z"}
    assert table(E.normalize_result(w), "obs", "category")["b", "z"] == 1
    assert table(E.max_annotation(w.filter("obs = 'a'")), "obs", "category")["a", "y"] == 0.5
    with pytest.raises(ValueError):
        E.inverse_mapping({"p": ["x"], "q": ["x"]})
    assert table(E.merge_annotation(w, {"p": ["x", "y"]}), "obs", "category")["a", "p"] == 1
    rows = spark.createDataFrame([("r0", "a", "b", "c"), ("r1", "b", "b", "b"), ("r2", "a", "a", "d"), ("r3", None, "d", "d"), ("r4", None, None, "a"), ("r5", None, None, None)], "k string, p string, q string, r string")
    assert [r["mode"] for r in E.row_mode(rows, "k", ["p", "q", "r"]).orderBy("k").collect()] == ["a", "b", "a", "d", "a", None]
    assert unused_key(["key", "key_1"]) == "key_0"
    m = long(spark, [[1, 2], [3, 5]])
    f = spark.createDataFrame([("o0", 0.5), ("o1", 0.5)], "obs string, factor double")
    assert table(E.scale(m, f, "obs", round=True), "obs", "var") == {("o0", "g0"): 0, ("o0", "g1"): 1, ("o1", "g0"): 2, ("o1", "g1"): 2}
    x = table(E.normalize_total(m), "obs", "var")
    assert x["o0", "g0"] + x["o0", "g1"] == pytest.approx(5.5)
    e = annotation_error(w.filter("obs = 'a'"), w.filter("obs = 'a'")).first()
    assert e["lp"] == 0 and e["projection"] == pytest.approx(1) and e["max_correct"] == 1


def test_quality_filters(spark):
    m = long(spark, [[5, 5, 1, 0], [5, 5, 0, 0], [5, 4, 0, 1], [0, 0, 0, 1]])
    (out,) = qc.filter_fixpoint([m], min_counts_per_gene=3, min_counts_per_cell=5, remove_constant_genes=False)
    assert {r["obs"] for r in out.collect()} == {"o0", "o1", "o2"} and "g2" not in {r["var"] for r in out.collect()}
    assert qc.counts_validity(m).first()["valid"] and not qc.counts_validity(m.withColumn("value", F.col("value") + 0.5)).first()["valid"]
    w = spark.createDataFrame([("a", "x", None), ("b", "x", 1.0), ("c", "x", -1.0)], "obs string, category string, weight double")
    with pytest.raises(ValueError):
        qc.filter_weights(w, "obs", "weight")
    assert [r["obs"] for r in qc.filter_weights(w, "obs", "weight", True, True).collect()] == ["b"]


def test_subsampling_and_platform(spark):
    lab = spark.createDataFrame([(f"o{i}", c) for i, c in enumerate(["a", "a", "ab", "ab", "bb", "bb"])], "obs string, category string")
    n = table(platform.subsample_annotation(lab, {"a": 2, "ab": 1, "b": 0.5}).groupBy("category").agg(F.sum("draws")), "category")
    assert n == {("a",): 4, ("ab",): 2, ("bb",): 1}
    with pytest.raises(KeyError):
        platform.subsample_annotation(lab, {"x": 1.0})
    m = long(spark, [[3, 1, 0], [1, 2, 2], [0, 1, 5]])
    scaled, f = platform.random_platform_effect(m, seed=3)
    back = platform.normalize_platform(scaled, None, m)
    a, b = table(back, "obs", "var"), table(m, "obs", "var")
    ratio = {round(a[k] / b[k], 6) for k in b}
    assert len(ratio) == 1


def test_orthology(spark):
    h = spark.createDataFrame([(1, 9606, "ISG15", None), (1, 10090, "Isg15", None), (2, 9606, "TP53", None), (2, 10090, "Trp53", "p53|Tp53"), (3, 9606, "GSTM2", None), (3, 10090, "Gstm7", None), (3, 10090, "Gstm8", None)], "key long, taxon int, symbol string, synonyms string")
    t = table(orthology.conversion(h, "human", "mouse"), "source", "target")
    assert t["ISG15", "Isg15"] == 1 and t["GSTM2", "Gstm7"] == 0.5
    x = spark.createDataFrame([("o", "TP53", 4.0), ("o", "GSTM2", 2.0), ("o", "none", 1.0)], "obs string, var string, value double")
    assert table(orthology.convert(x, orthology.conversion(h, 9606, 10090)), "obs", "var") == {("o", "Trp53"): 4, ("o", "Gstm7"): 1, ("o", "Gstm8"): 1}
    assert {r["name"] for r in orthology.incidence(h, "mouse", True).collect()} >= {"p53", "Trp53"}


def test_frame_and_files(spark, tmp_path):
    x = long(spark, [[1, 2], [3, 0]])
    obs = spark.createDataFrame([("o0", "a", 1.0), ("o1", None, 2.0)], "obs string, type string, x double")
    f = AnnotatedFrame(x, obs, obsm={"soft": one_hot(obs.select("obs", F.col("type").alias("category")))}, layers={"l": x})
    assert f.query("x > 1").counts.count() == 1
    assert f.values("type").columns == ["obs", "type"] and f.values(("X", "g0")).count() == 2 and f.values("g1").count() == 1
    assert f.soft("type").count() == 1 and f.matrix(("layer", "l")).count() == 3 and f.matrix(("obsm", "soft")).count() == 1
    with pytest.raises(KeyError):
        f.values("nowhere")
    write_frame(f, str(tmp_path / "frame"))
    g = read_frame(spark, str(tmp_path / "frame"))
    assert table(g.counts, "obs", "var") == table(x, "obs", "var") and g.obsm["soft"].count() == 1 and "l" in g.layers
    write_tsv(obs, str(tmp_path / "t"))
    assert read_tsv(spark, str(tmp_path / "t")).count() == 2
    m = distribute_molecules(x, obs.withColumn("y", F.lit(0.0)), 0.1)
    assert m.count() == 6


def test_merge_contributions(spark):
    groups = spark.createDataFrame([(f"o{i}", g) for i, g in enumerate((0, 0, 1, 1, 1, 2, 2, 2))], "obs string, group int")
    vals = one_hot(spark.createDataFrame([(f"o{i}", str(v)) for i, v in enumerate((5, 5, 6, 6, 6, 5, 6, 7))], "obs string, category string"))
    t = table(A.contributions(vals, groups).drop("sample"), "group", "value_key")
    assert [[t[str(g), str(v)] for v in (5, 6, 7)] for g in range(3)] == [[2, 0, 0], [0, 3, 0], [1, 1, 1]]
    assert A.contributions(vals, groups, restrict_groups=["0", "2"]).select("group").distinct().count() == 2
    clr = table(A.contributions(vals, groups, normalization="clr").drop("sample"), "group", "value_key")
    assert clr["2", "5"] == 0 and clr["0", "5"] is None


def test_figures_and_components(spark):
    from lodestone.operators import embedding, plotdata
    from lodestone.testing import assert_annotated_equal, assert_frame_equal, measure

    assert len(plotdata.default_colors(5)) == 5
    w = spark.createDataFrame([("o", "a", 1.0), ("o", "b", 1.0), ("p", "a", 2.0)], "obs string, category string, weight double")
    c = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 0.0, 1.0, 1.0)], "category string, r double, g double, b double")
    rgb = table(plotdata.mix_colors(w, c), "obs")
    assert rgb["o",] == (0.5, 0.5, 0.5) and rgb["p",] == (1, 0, 0)
    xyv = table(plotdata.mix_colors(w, c, "xyv"), "obs")
    assert xyv["o",] == pytest.approx((1, 1, 1), abs=1e-9) and xyv["p",] == pytest.approx((1, 0, 0), abs=1e-9)
    t = spark.createDataFrame([("v", "g", "enriched", 0.0005), ("v", "g", "purified", 1.0), ("w", "g", "enriched", 0.9), ("w", "g", "purified", 0.02)], "value string, group string, enrichment string, p_adjusted double")
    m = {r["value"]: r for r in plotdata.significance_map(t).collect()}
    assert m["v"]["stars"] == "***" and m["v"]["signed"] == pytest.approx(-math.log(0.0005)) and m["w"]["stars"] == "*" and m["w"]["signed"] == pytest.approx(math.log(0.02))
    r, k = plotdata.diagonal_order(np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0]]))
    assert np.array_equal(np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0]])[np.ix_(r, k)], np.eye(3))
    pts = spark.createDataFrame([("o", 0.0, 5.0), ("p", 1.0, 7.0)], "obs string, x double, y double")
    assert table(plotdata.label_positions(pts, w), "category")["a",] == (1.0, 7.0)
    rng = np.random.default_rng(0)
    x = rng.random((60, 2)) @ rng.random((2, 6)) + 0.5
    d = long(spark, x)
    axes, var, names = embedding.pca(d, 3)
    true = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(var, true[:3], atol=1e-10)
    s = {r["obs"]: r["scores"] for r in embedding.project(d, axes, names).collect()}
    assert np.allclose(s["o7"], x[7] @ axes)
    assert_frame_equal(d, d.orderBy("value"))
    with pytest.raises(AssertionError):
        assert_frame_equal(d, d.limit(3))
    f = AnnotatedFrame(d)
    assert_annotated_equal(f, f.replace())
    assert measure(lambda: d)["time_s"] > 0


def test_streams(spark, tmp_path):
    from lodestone.streaming.incremental import run_to_table, running_totals, stream_table

    long(spark, [[1, 2], [3, 0]]).write.parquet(str(tmp_path / "c"))
    assert table(run_to_table(running_totals(stream_table(spark, str(tmp_path / "c"))), "t_test").drop("entries"), "var") == {("g0",): 4, ("g1",): 2}
