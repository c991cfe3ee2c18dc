import numpy as np
import pytest

from lodestone.llm.clusters import FeatureTree, assign, describe, ward
from lodestone.llm.neighbours import Hashes, candidates_for, exact, mutual, nearest, trees_for
from lodestone.llm.vectors import dense


def counts(spark, m, names=None):
    rows = [(names[i] if names else f"o{i:04}", f"g{j}", float(v), 0) for i, r in enumerate(m) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "obs string, var string, value double, load_id int")


def test_dense_cleans(spark):
    nan = float("nan")
    rows = [("a", "g0", 2.0, 1), ("a", "g0", 3.0, 2), ("a", "g1", nan, 1), ("a", "g1", 4.0, 0), ("b", "g0", 0.0, 1), ("c", "g1", None, 1), (None, "g1", 1.0, 1), ("d", None, 1.0, 1), ("e", "g1", -1.0, 1), ("f", "g1", 7.0, 1)]
    v, size = dense(spark.createDataFrame(rows, "obs string, var string, value double, load_id int"))
    got = {r["k"]: np.frombuffer(r["v"], np.float32).tolist() for r in v.collect()}
    assert size == 2 and got == {"a": [3.0, 0.0], "e": [0.0, -1.0], "f": [0.0, 7.0]}


def test_hash_strings_of_near_vectors_share_long_prefixes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 40)).astype(np.float32)
    h = Hashes(40, np.zeros(40, np.float32), 6, 0)
    column = lambda m: [r.astype(np.float32).tobytes() for r in m]
    a, b, c = h(column(x)), h(column(x + 0.01 * rng.standard_normal(x.shape))), h(column(rng.standard_normal((200, 40))))
    assert (a == h(column(7 * x))).all()  # only directions count
    assert ((a >> 32) == (b >> 32)).mean() > 0.9 and ((a >> 32) == (c >> 32)).mean() < 0.1


def test_the_compared_share_falls_as_vectors_are_added():
    share = [candidates_for(n) / n for n in (3_000, 30_000, 300_000, 3_000_000)]
    assert share == sorted(share, reverse=True) and share[0] < 0.3 and share[2] < 0.07
    assert trees_for(3_000) > 30 > 18 >= trees_for(300_000) >= 16


def brute(m, k):
    x = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.poisson(2, (12, 40)) + 0.2
    m = np.array([rng.poisson(base[i % 12] * 3) for i in range(600)], float)
    m[300:330] = m[:30] + rng.poisson(0.05, (30, 40))
    best, s = brute(m, 5)
    out = nearest(*dense(counts(spark, m)), k=5).collect()
    got = {}
    for r in out:
        got.setdefault(int(r["k"][1:]), set()).add(int(r["neighbour"][1:]))
        assert r["similarity"] == pytest.approx(s[int(r["k"][1:]), int(r["neighbour"][1:])], abs=1e-4)
    assert np.mean([len(got[i] & set(best[i])) / 5 for i in range(600)]) >= 0.9
    pairs = {tuple(r) for r in mutual(nearest(*dense(counts(spark, m)), k=5), 0.97).collect()}
    true = {(f"o{i:04}", f"o{j:04}") for i in range(600) for j in best[i] if i < j and s[i, j] >= 0.97 and i in best[j]}
    assert pairs == true and len(true) >= 25


def test_recall_with_far_fewer_candidates_than_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.gamma(1, 2, (40, 60)) + 0.1
    m = rng.poisson(base[np.arange(3000) % 40] * 3).astype(float)
    vectors, size = dense(counts(spark, m))
    best, s = brute(m, 5)
    got = {}
    for r in nearest(vectors, size, k=5, candidates=300).collect():
        got.setdefault(int(r["k"][1:]), set()).add(int(r["neighbour"][1:]))
    assert np.mean([len(got[i] & set(best[i])) / 5 for i in range(3000)]) >= 0.9
    every = {}
    for r in exact(vectors, size, k=5).collect():
        every.setdefault(int(r["k"][1:]), []).append((r["rank"], int(r["neighbour"][1:])))
    for i, near in every.items():
        assert np.allclose([s[i, j] for _, j in sorted(near)], [s[i, j] for j in best[i]], atol=1e-5)


def test_a_crowd_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    from lodestone.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(6)
    m = np.vstack([np.tile(rng.poisson(50, 20) + 1, (90, 1)) + rng.poisson(0.3, (90, 20)), rng.poisson(5, (30, 20)) + 0.5]).astype(float)
    best, s = brute(m, 3)
    got = {}
    for r in nearest(*dense(counts(spark, m)), k=3).collect():
        got.setdefault(int(r["k"][1:]), []).append(s[int(r["k"][1:]), int(r["neighbour"][1:])])
    assert np.mean([abs(min(got[i]) - s[i, best[i][2]]) < 1e-5 for i in range(90)]) >= 0.9


def test_negative_values_count(spark):
    m = np.array([[1.0, -2, 3], [1, -2, 2.9], [1, 2, 3], [1, 2, 2.9]])
    near = {r["k"]: r["neighbour"] for r in nearest(*dense(counts(spark, m)), k=1).collect()}
    assert near == {"o0000": "o0001", "o0001": "o0000", "o0002": "o0003", "o0003": "o0002"}


def test_copies_and_ties(spark):
    m = np.array([[1, 2, 3, 0]] * 30 + [[0, 1, 0, 5], [4, 0, 0, 1]], float)
    out = nearest(*dense(counts(spark, m)), k=3).collect()
    by = {}
    for r in out:
        by.setdefault(r["k"], []).append((r["rank"], r["neighbour"], round(r["similarity"], 5)))
    assert len(by) == 32 and all(len(v) == 3 for v in by.values())
    assert sorted(by["o0020"]) == [(1, "o0000", 1.0), (2, "o0001", 1.0), (3, "o0002", 1.0)]
    assert sorted(by["o0000"]) == [(1, "o0001", 1.0), (2, "o0002", 1.0), (3, "o0003", 1.0)]


def test_empty_and_single(spark):
    empty = counts(spark, np.eye(3)).limit(0)
    assert nearest(*dense(empty)).count() == 0
    assert nearest(*dense(counts(spark, np.eye(1)))).count() == 0
    assert assign(*dense(empty), 3).count() == 0


def test_ward_equals_merging_by_hand():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [9.0]])
    n, s, q = ward(np.ones(5), x, (x * x).sum(1), 3)
    assert sorted((s / n[:, None]).ravel().round(3)) == [0.05, 5.1, 9.0]
    t = FeatureTree(1, 4)
    t.insert(np.random.default_rng(0).random((3000, 1)))
    n, s, q = t.features()
    assert n.sum() == 3000 and len(n) <= 4


def test_tree_branches_and_keeps_every_row():
    x = np.random.default_rng(0).random((6000, 3))
    t = FeatureTree(3, 300)
    t.insert(x)
    n, s, q = t._all()
    assert n.sum() == pytest.approx(6000) and np.allclose(s.sum(0), x.sum(0)) and q.sum() == pytest.approx((x * x).sum())
    assert t.depth() > 1 and max(len(k.n) for k in t.root.leaves()) <= 32 and len(n) <= 600
    t = FeatureTree(1, 50)
    t.insert(np.zeros((500, 1)))  # all alike
    assert len(t._all()[0]) <= 100 and t._all()[0].sum() == 500


def test_clusters_are_found(spark):
    rng = np.random.default_rng(1)
    base = rng.gamma(1, 2, (4, 30)) + 0.1
    size = [300, 150, 60, 25]
    truth = np.repeat(range(4), size)
    m = np.array([rng.poisson(base[t] * 4) for t in truth], float)
    a = assign(*dense(counts(spark, m)), 4)
    labels = spark.createDataFrame([(f"o{i:04}", None if i % 10 == 0 else f"Type {t}" if i % 2 else f"type_{t}") for i, t in enumerate(truth)], "k string, label string")
    categories = spark.createDataFrame([(f"Type {t}",) for t in range(4)], "annotation_key string")
    members, clusters = describe(a, labels, categories)
    rows = {r["cluster"]: r for r in clusters.collect()}
    assert sorted(r["members"] for r in rows.values()) == sorted(size)
    for r in a.collect():
        assert rows[r["cluster"]]["prevailing_label"] == f"Type {truth[int(r['k'][1:])]}"
    assert all(len(r["typical_members"]) == 5 for r in rows.values())


def test_more_clusters_than_rows(spark):
    a = assign(*dense(counts(spark, np.array([[1, 0.0], [1, 0], [0, 2]]))), 12).collect()
    by = {r["k"]: r["cluster"] for r in a}
    assert len(by) == 3 and by["o0002"] not in (by["o0000"],)


def pairs_by_brute_force(m, least, k=5):
    """Pairs of at least that cosine, each among the other's k first; ties at six digits go to the smaller name."""
    x = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    first = [set(np.argsort(-row, kind="stable")[:k].tolist()) for row in s]
    return {(f"o{i:04}", f"o{j:04}") for i, j in zip(*np.nonzero(s >= least)) if i < j and j in first[i] and i in first[j]}


def planted(n=3000, copies=120):
    rng = np.random.default_rng(8)
    base = rng.gamma(1, 2, (20, 60)) + 0.1
    m = rng.poisson(base[np.arange(n) % 20] * 3).astype(float)
    m[-copies:] = m[:copies] + rng.poisson(0.2, (copies, 60))
    return m


def test_alike_compares_only_what_may_be_alike(spark, monkeypatch):
    from lodestone.llm import neighbours

    m = planted()
    true, compared, found = pairs_by_brute_force(m, 0.97), [], neighbours._found
    monkeypatch.setattr(neighbours, "_found", lambda entries, *rest, **how: (compared.append(entries.select("id").distinct().count()), found(entries, *rest, **how))[1])
    assert {tuple(r) for r in neighbours.alike(*dense(counts(spark, m)), 0.97).collect()} == true and len(true) > 100
    near = int((brute(m, 5)[1] >= 0.96).any(1).sum())
    assert compared[0] <= near < len(m) / 2
    monkeypatch.setattr(neighbours, "fitting", lambda *a: (3, 30))  # many short groups
    assert {tuple(r) for r in neighbours.alike(*dense(counts(spark, m)), 0.97).collect()} == true
    assert compared[1] <= near


def test_alike_in_crowds_and_ties(spark, monkeypatch):
    from lodestone.llm import neighbours

    rng = np.random.default_rng(6)
    crowd = np.tile(rng.poisson(50, 20) + 1, (90, 1)) + rng.poisson(0.3, (90, 20))
    multiples = np.outer(rng.permutation(40) + 1, rng.poisson(9, 20) + 1)  # equal directions, no copies
    m = np.vstack([crowd, multiples, rng.poisson(5, (30, 20)) + 0.5]).astype(float)
    true = pairs_by_brute_force(m, 0.97)
    assert len(true) > 50 and {tuple(r) for r in neighbours.alike(*dense(counts(spark, m)), 0.97).collect()} == true
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    assert {tuple(r) for r in neighbours.alike(*dense(counts(spark, m)), 0.97).collect()} == true


def test_few_pairs_are_missed_and_work_grows_slowly():
    from lodestone.llm.neighbours import Codes, fitting

    m = planted()
    x = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    rng = np.random.default_rng(1)
    for n in (300_000, 40_000_000):
        symbols, trees = fitting(x[:2000], n, 0.97, 0)
        codes = Codes(x[:2000].mean(0), symbols, trees, 3)
        z = rng.standard_normal(x.shape).astype(np.float32)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.97 * x + np.sqrt(1 - 0.97**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        met = [(a[:, None] == b[None]).any() for a, b in zip(codes(x), codes(y))]
        assert np.mean(met) > 0.998
        assert symbols >= 2 and trees * codes.probes < 600


def test_alike_of_few(spark):
    from lodestone.llm.neighbours import alike

    assert alike(*dense(counts(spark, np.eye(3)).limit(0)), 0.97).count() == 0
    assert alike(*dense(counts(spark, np.eye(1))), 0.97).count() == 0
    assert alike(*dense(counts(spark, np.eye(3))), 0.97).count() == 0
    assert [tuple(r) for r in alike(*dense(counts(spark, np.array([[2.0], [3.0]]))), 0.97).collect()] == [("o0000", "o0001")]
    copies = np.array([[1, 2, 3, 0]] * 30 + [[0, 1, 0, 5]], float)
    assert {tuple(r) for r in alike(*dense(counts(spark, copies)), 0.97).collect()} == pairs_by_brute_force(copies, 0.97)


def test_repeats_are_settled_alike_by_either_way(spark, monkeypatch):
    from lodestone.llm import vectors

    nan, inf = float("nan"), float("inf")
    rows = [("a", "u", 2.0, 1), ("a", "u", nan, 1), ("a", "u", 9.0, None), ("a", "v", 3.0, 1), ("a", "v", 4.0, 1), ("a", "w", 5.0, 1), ("a", "w", None, 2), ("b", "u", inf, 3), ("b", "v", -1.0, -5), ("b", "v", 7.0, None)]
    table = spark.createDataFrame(rows * 3, "obs string, var string, value double, load_id int")
    for kind in ("int", "bigint", "string"):
        for repeats in (16, 0):
            monkeypatch.setattr(vectors, "REPEATS", repeats)
            got = {r["k"]: np.frombuffer(r["v"], np.float32).tolist() for r in dense(table.withColumn("load_id", table["load_id"].cast(kind)))[0].collect()}
            assert got == {"a": [2.0, 4.0, 0.0], "b": [0.0, -1.0, 0.0]}
