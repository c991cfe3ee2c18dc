import random

import numpy as np
import pytest

from lodestone.functions.geometry import cover, dual_tree_pairs, in_polygon
from lodestone.operators.nearby import inside_regions, latest, near_pairs, neighbourhood


def brute(points, radius):
    return {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and a[3] == b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2}


def test_dual_tree_equals_brute_force():
    rng = np.random.default_rng(0)
    a, b = rng.random((300, 2)) * 10, np.vstack([rng.random((200, 2)) * 10, np.full((60, 2), 5.0)])
    got = {(i, j) for x, y in dual_tree_pairs(a, b, 1.5, block=500) for i, j in zip(x.tolist(), y.tolist())}
    assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if ((a[i] - b[j]) ** 2).sum() <= 2.25}
    assert not list(dual_tree_pairs(a[:0], b, 1.0))


@pytest.mark.parametrize("tile", [8, 4096])
def test_near_pairs_equals_brute_force(spark, tile):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.randrange(-200, 200) / 4, rng.randrange(-200, 200) / 4, rng.choice("ab")) for i in range(250)] + [(f"c{i}", 3.0, 3.0, "a") for i in range(30)]
    df = spark.createDataFrame(rows, "obs string, x double, y double, sample string")
    found = near_pairs(df, 5.0, groups=["sample"], tile_points=tile).collect()
    assert {tuple(r)[:2] for r in found} == brute(rows, 5.0) and len(found) == len(brute(rows, 5.0))
    at = {r[0]: r[1:3] for r in rows}
    assert all(abs(d - np.hypot(*np.subtract(at[a], at[b]))) < 1e-12 for a, b, d in found)


def test_near_pairs_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.0, 0.0, "s", 1), ("b", 12.5, 0.0, "s", 2), ("b", 12.5, 0.0, "s", 2), ("c", nan, 0.0, "s", 3), ("d", None, 0.0, "s", 4), (None, 0.0, 0.0, "s", 5), ("e", 0.0, 0.0, None, 6), ("f", inf, 0.0, "s", 7), ("g", 0.0, 0.0, "s", 8)]
    df = spark.createDataFrame(rows, "obs string, x double, y double, sample string, g long")  # g clashes with an inner name
    got = sorted(tuple(r)[:2] for r in near_pairs(df, 12.5, groups=["sample"]).collect())
    assert got == [("a", "b"), ("a", "g"), ("b", "g")]
    assert near_pairs(df.limit(0), 12.5, groups=["sample"]).count() == 0
    assert sorted(tuple(r)[:2] for r in near_pairs(df, 0.0, groups=["sample"]).collect()) == [("a", "g")]


def test_polygons(spark):
    star = ([0.0, 10.0, 10.0, 5.0, 0.0], [0.0, 0.0, 10.0, 3.0, 10.0])
    assert in_polygon([5.0, 5.0, 0.0, 20.0], [1.0, 6.0, 5.0, 1.0], *star).tolist() == [True, False, True, False]
    rng = np.random.default_rng(2)
    p = rng.random((500, 2)) * 14 - 2
    nodes = {(k, x, y): e for k, x, y, e in cover(*star, 0.7)}
    for (x, y), inside in zip(p, in_polygon(p[:, 0], p[:, 1], *star)):
        c = [nodes[n] for k in range(8) if (n := (k, int(np.floor(x / 0.7 / 2**k)), int(np.floor(y / 0.7 / 2**k)))) in nodes]
        assert len(c) == 1 if inside else not c or (len(c) == 1 and c[0] is not None)
    # a region far larger than the finest cell has few nodes inside
    assert sum(e is None for *_, e in cover([0.0, 1000.0, 1000.0, 0.0], [0.0, 0.0, 1000.0, 1000.0], 1.0)) < 20_000
    df = spark.createDataFrame([(f"o{i}", float(x), float(y)) for i, (x, y) in enumerate(p)], "obs string, x double, y double")
    rings = [("r1", *star), ("r2", star[0][::-1], star[1][::-1]), ("closed", [*star[0], 0.0], [*star[1], 0.0]), ("line", [0.0, 1.0], [0.0, 1.0]), ("bad", [0.0, None, 1.0], [0.0, 1.0, 1.0]), (None, *star)]
    regions = spark.createDataFrame(rings, "region_id string, xs array<double>, ys array<double>")
    got = {tuple(r) for r in inside_regions(df, regions).collect()}
    assert got == {(f"o{i}", r) for i, ok in enumerate(in_polygon(p[:, 0], p[:, 1], *star)) if ok for r in ("r1", "r2", "closed")}
    assert inside_regions(df, regions.limit(0)).count() == 0 and inside_regions(df.limit(0), regions).count() == 0


def test_a_crowd_is_searched_in_blocks(spark):
    rows = [(f"k{i:03d}", 5.0, 5.0) for i in range(60)] + [("z", 5.5, 5.0), ("y", 40.0, 5.0)]
    df = spark.createDataFrame(rows, "obs string, x double, y double")
    found = near_pairs(df, 1.0, tile_points=7).collect()
    assert len(found) == len(set(found)) == 60 * 59 // 2 + 60


def test_no_join_of_points_is_a_broadcast(spark, capsys):
    df = spark.range(500).selectExpr("cast(id as string) as obs", "cast(id % 50 as double) as x", "cast(id / 50 as double) as y")
    near_pairs(df, 2.0).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_latest_row_counts(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 5, 2), ("b", 3, None), (None, 1, 1)], "obs string, v int, t int")
    assert sorted((r["obs"], r["v"]) for r in latest(df, "obs", "t").collect()) == [("a", 5), ("b", 3)]


def test_neighbourhood_of_moved_observation(spark):
    obs = spark.createDataFrame([("a", "s", 0, 0.0, 0.0, 1), ("b", "s", 0, 1.0, 0.0, 1), ("b", "s", 0, 99.0, 0.0, 2), ("c", "s", 1, 0.0, 0.0, 1)], "obs string, sample string, section int, x double, y double, loaded_at int")
    regions = spark.createDataFrame([("r", [-1.0, 1.0, 1.0, -1.0], [-1.0, -1.0, 1.0, 1.0])], "region_id string, xs array<double>, ys array<double>")
    assert sorted(tuple(r) for r in neighbourhood(obs, regions).collect()) == [("inside", "a", "r"), ("inside", "c", "r")]
