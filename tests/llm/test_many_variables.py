"""Vectors of more variables than ``DIMENSIONS``."""

import numpy as np

from lodestone.llm.clusters import assign, directions
from lodestone.llm.neighbours import nearest
from lodestone.llm.vectors import DIMENSIONS, dense, unit


def _matrix():
    rng = np.random.default_rng(3)
    m = np.zeros((40, DIMENSIONS + 900))
    for i in range(40):  # four groups, each of variables of its own
        own = np.arange(i % 4, m.shape[1], 4)
        m[i, rng.choice(own, 600, replace=False)] = rng.integers(1, 9, 600)
    m[0, :] += np.arange(m.shape[1]) % 4 == 0  # every variable occurs
    m[1, 1::4] += 1
    m[2, 2::4] += 1
    m[3, 3::4] += 1
    return m


def _counts(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(f"o{a:02d}", f"v{b}", float(m[a, b]), 1) for a, b in zip(i, j)], "obs string, var string, value double, load_id int")


def test_similarities_are_exact(spark):
    m = _matrix()
    vectors, size = dense(_counts(spark, m))
    assert size == m.shape[1]
    s = unit(m) @ unit(m).T
    np.fill_diagonal(s, -2)
    found = {}
    for r in nearest(vectors, size, k=5).collect():
        found.setdefault(int(r["k"][1:]), {})[int(r["neighbour"][1:])] = r["similarity"]
    assert len(found) == 40
    for i, near in found.items():
        assert set(near) == set(np.argsort(-s[i])[:5].tolist())
        assert all(abs(x - s[i, j]) < 1e-5 for j, x in near.items())


def test_clusters_of_exact_directions(spark):
    m = _matrix()
    got = {int(r["k"][1:]): (r["cluster"], r["distance"]) for r in assign(*dense(_counts(spark, m)), 4).collect()}
    x = directions(m)
    for g in range(4):
        rows = range(g, 40, 4)
        assert len({got[i][0] for i in rows}) == 1
        centre = x[list(rows)].mean(0)
        assert all(abs(got[i][1] - np.linalg.norm(x[i] - centre)) < 1e-5 for i in rows)


def test_alike_is_exact(spark):
    from lodestone.llm.neighbours import alike

    m = _matrix()
    m[20:24] = m[:4] + 0.01
    s = unit(m) @ unit(m).T
    np.fill_diagonal(s, -2)
    first = [set(np.argsort(-r, kind="stable")[:5].tolist()) for r in s]
    true = {(f"o{i:02d}", f"o{j:02d}") for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.97 and j in first[i] and i in first[j]}
    assert {tuple(r) for r in alike(*dense(_counts(spark, m)), 0.97).collect()} == true and len(true) == 4
