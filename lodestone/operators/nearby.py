"""Points near other points, and the regions around them.

``near_pairs`` joins points within a distance by a dual-tree search cut into tasks: a quadtree over occupied cells
gives tiles of a bounded number of points, every tile is compared only with points of the cells around it, and
inside a task a pair of bounding-box trees discards, accepts or refines node pairs. A tile that cannot be divided
further (a crowd in one cell) is compared block by block, so that no comparison holds more than ``2 * tile_points``
points, however many coincide; pairs leave a task in batches.

Defined results: rows with a null key, group or coordinate, or a coordinate that is not finite, take no part. Rows
that repeat a key at the same place count once; a key at several places is near by any of them. Points at distance
0 are near. Empty inputs give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.geometry import cover, dual_tree_pairs
from lodestone.runtime import cut, partitions

#: Levels of the quadtree above the finest cells: a tile is at most 2**8 cells wide.
LEVELS = 8
#: Points of one task, cells of a task that lays out tiles, pairs of a batch.
BIN, SQUARE, PAIRS = 131_072, 65_536, 262_144
#: Most crowded cells, and most entries of region nodes, that are broadcast.
CROWDS, NODES = 50_000, 1_000_000


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each key with the latest ``at`` (nulls first); equal rows collapse, and among rows equal in ``at``
    the greatest in the other columns counts. Null keys are dropped. Aggregates before shuffling."""
    rest = [c for c in df.columns if c not in (key, at)]
    row = F.struct(F.col(f"`{at}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    best = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("k")).agg(F.max(row).alias("r"))
    out = {c: F.col(f"r.c{i}") for i, c in enumerate(rest)} | {key: F.col("k"), at: F.col("r.t")}
    return best.select(*[out[c].alias(c) for c in df.columns])


def _clean(df: DataFrame, key: str, x: str, y: str, groups: Sequence[str]) -> DataFrame:
    c = lambda n: F.col(f"`{n}`")
    g = F.struct(*[c(n).alias(f"g{i}") for i, n in enumerate(groups)]) if groups else F.struct(F.lit(0).alias("g0"))
    out = df.select(c(key).cast("string").alias("k"), c(x).cast("double").alias("x"), c(y).cast("double").alias("y"), g.alias("g"), *[c(n).alias(f"n{i}") for i, n in enumerate(groups)])
    fine = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    out = out.filter(F.col("k").isNotNull() & fine("x") & fine("y"))
    for i in range(len(groups)):
        out = out.filter(F.col(f"n{i}").isNotNull())
    return out.select("k", "x", "y", "g")


def _tiles(cx: np.ndarray, cy: np.ndarray, n: np.ndarray, m: np.ndarray, own: np.ndarray, bound: int) -> dict[str, np.ndarray]:
    """Quadtree tiles of the ``own`` cells of a square, each with the cells it meets (its own and those around them); cells are
    numbered from the square's corner.

    A tile is the largest node that holds at most ``bound`` points to search for (n) and as many to find (m)."""
    mine = np.flatnonzero(own)
    x, y, load = cx[mine], cy[mine], np.maximum(n, m)[mine]
    level, rest = np.zeros(len(mine), np.int64), np.arange(len(mine))
    for k in range(LEVELS, -1, -1):
        node = ((x[rest] >> k) << LEVELS) | (y[rest] >> k)
        _, to = np.unique(node, return_inverse=True)
        fits = (np.bincount(to, load[rest])[to] <= bound) | (k == 0)
        level[rest[fits]] = k
        rest = rest[~fits]
        if not len(rest):
            break
    _, tile = np.unique((level << (2 * LEVELS)) | ((x >> level) << LEVELS) | (y >> level), return_inverse=True)
    at = lambda i, j: (i + 1) * (4 << LEVELS) + j + 1
    order = np.argsort(at(cx, cy), kind="stable")
    known = at(cx, cy)[order]
    met = []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            want = at(x + dx, y + dy)
            place = np.minimum(np.searchsorted(known, want), len(known) - 1)
            hit = known[place] == want
            met.append(tile[hit] * len(cx) + order[place[hit]])
    t, cell = np.divmod(np.unique(np.concatenate(met)), len(cx))
    home = np.full(len(cx), -1, np.int64)
    home[mine] = tile
    count = int(tile.max()) + 1
    left, right = np.bincount(tile, n[mine], count), np.bincount(t, m[cell], count)
    blocks = lambda c: np.maximum(1, -(-c // bound)).astype(np.int32)
    used = (left[t] > 0) & (right[t] > 0)
    out = {"cell": cell, "tile": t.astype(np.int32), "own": home[cell] == t, "sl": blocks(left)[t], "sr": blocks(right)[t]}
    return {k: v[used] for k, v in out.items()}


def tiled(points: DataFrame, radius: float, search, schema: str, tile_points: int = 4096) -> DataFrame:
    """``search(left, right)`` on every tile of points (k, x, y, g, l, r), where l and r say whether a point is searched for or to
    be found; ``search`` yields frames of ``schema`` and gets every point to be found within the radius of those on its left.

    The joins are shuffles of cells and points, whatever their sizes; a cell of more than ``tile_points`` points is salted, and a
    tile of more is searched in blocks. A task takes several tiles, as many as make a bounded number of points."""
    size = float(radius) if radius > 0 else 1.0
    spark = points.sparkSession
    group = [F.xxhash64("g").alias("g1"), F.xxhash64(F.lit(1), "g").alias("g2")]
    cell = lambda c: F.floor(F.col(c) / size).cast("long").alias(f"c{c}")
    points = points.select(*group, cell("x"), cell("y"), "k", "x", "y", "l", "r")
    where = ["g1", "g2", "cx", "cy"]
    cells = points.groupBy(*where).agg(F.count_if("l").alias("n"), F.count_if("r").alias("m"))
    # a square of 2**LEVELS cells, with the cells around it, is laid out in one task: a bounded number of cells
    side = 1 << LEVELS
    meets = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side) for d in (-1, 0, 1)])))
    halo = cells.withColumn("sx", meets("cx")).withColumn("sy", meets("cy"))
    squares = max(partitions(spark), points.count() // SQUARE)

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        square, n, m = pdf.groupby(["g1", "g2", "sx", "sy"], sort=False).ngroup().to_numpy(), pdf["n"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64)
        x, y = (pdf[c].to_numpy(np.int64) - pdf[s].to_numpy(np.int64) * side for c, s in (("cx", "sx"), ("cy", "sy")))
        own = (x >= 0) & (x < side) & (y >= 0) & (y < side)
        left, right, all_right = (np.bincount(square, c) for c in (n * own, m * own, m))
        live = (left > 0) & (all_right > 0)
        # a square of few points is one tile, which meets all of the cells around it
        small = live & (np.maximum(left, right) <= tile_points)
        whole = small[square]
        blocks = np.maximum(1, -(-all_right // tile_points)).astype(np.int32)
        keep = pdf[[*where, "sx", "sy"]].assign(n=n + m)
        parts = [keep[whole].assign(tile=0, own=own[whole], sl=1, sr=blocks[square[whole]])]
        order = np.argsort(square, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(square[order])) + 1):
            if live[square[at[0]]] and not small[square[at[0]]]:
                t = _tiles(x[at], y[at], n[at], m[at], own[at], tile_points)
                parts.append(keep.iloc[at[t.pop("cell")]].assign(**t))
        return pd.concat(parts)

    laid = halo.groupBy(F.pmod(F.xxhash64("g1", "g2", "sx", "sy"), F.lit(squares)).alias("square"))
    role = cut(laid.applyInPandas(lay, "g1 long, g2 long, cx long, cy long, sx long, sy long, n long, tile int, own boolean, sl int, sr int"))
    load, crowds = role.agg(F.sum("n"), F.count_if(F.col("own") & (F.col("n") > tile_points))).first()
    if not load:
        return spark.createDataFrame([], schema)
    if crowds:
        # a crowd takes the salts of its own, a cell with fewer points one
        salts = F.ceil(F.col("n") / tile_points).cast("int")
        crowd = role.filter(F.col("own") & (F.col("n") > tile_points)).select(*where, salts.alias("salts"))
        points = points.join(F.broadcast(crowd) if crowds <= CROWDS else crowd.hint("merge"), where, "left")
        points = points.withColumn("salt", F.pmod(F.xxhash64("k", "x"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        role = role.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), salts) - 1)))
        where = [*where, "salt"]
    routed = points.join(role.hint("merge"), where)
    h = F.xxhash64("k", "x", "y")
    lb, rb = F.pmod(h, F.col("sl")).cast("int"), F.pmod(h, F.col("sr")).cast("int")
    place = lambda a, b, side: F.struct(a.alias("bl"), b.alias("br"), F.lit(side).alias("side"))
    as_left = F.when(F.col("own") & F.col("l"), F.transform(F.sequence(F.lit(0), F.col("sr") - 1), lambda j: place(lb, j, 1))).otherwise(F.array().cast("array<struct<bl:int,br:int,side:int>>"))
    as_right = F.when(F.col("r"), F.transform(F.sequence(F.lit(0), F.col("sl") - 1), lambda i: place(i, rb, 2))).otherwise(F.array().cast("array<struct<bl:int,br:int,side:int>>"))
    one = (F.col("sl") == 1) & (F.col("sr") == 1)
    both = F.array(place(F.lit(0), F.lit(0), 3))
    seats = F.when(one & F.col("own") & F.col("l") & F.col("r"), both).otherwise(F.concat(as_left, as_right))
    seated = routed.select("g1", "g2", "sx", "sy", "tile", "k", "x", "y", F.explode(seats).alias("p")).select("g1", "g2", "sx", "sy", "tile", "p.*", "k", "x", "y")
    task = ["g1", "g2", "sx", "sy", "tile", "bl", "br"]
    seated = seated.select(F.xxhash64(*task).alias("t1"), F.xxhash64(F.lit(1), *task).alias("t2"), "k", "x", "y", "side")
    tasks = max(partitions(spark), int(load // BIN) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        t1, t2 = pdf["t1"].to_numpy(), pdf["t2"].to_numpy()
        order = np.lexsort([t2, t1])
        new = np.flatnonzero((np.diff(t1[order]) != 0) | (np.diff(t2[order]) != 0)) + 1
        names, xy, sides = pdf["k"].to_numpy(object), pdf[["x", "y"]].to_numpy(), pdf["side"].to_numpy()
        for part in np.split(order, new):
            a, b = part[sides[part] & 1 > 0], part[sides[part] & 2 > 0]
            if len(a) and len(b):
                yield from search((names[a], xy[a]), (names[b], xy[b]))

    return seated.groupBy(F.pmod("t1", F.lit(tasks)).alias("bin")).applyInPandas(run, schema)


def near_pairs(df: DataFrame, radius: float, key: str = "obs", x: str = "x", y: str = "y", groups: Sequence[str] = (), tile_points: int = 4096) -> DataFrame:
    """(key_a, key_b, distance) with key_a < key_b, of points of one group at most ``radius`` apart; the least distance of keys
    that are at several places."""
    if radius < 0:
        raise ValueError("radius < 0")
    points = cut(_clean(df, key, x, y, groups))
    repeated = points.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").take(1)

    def search(left, right):
        (ka, a), (kb, b) = left, right
        for i, j in dual_tree_pairs(a, b, radius):
            less = ka[i] < kb[j]
            i, j = i[less], j[less]
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                yield pd.DataFrame({"key_a": ka[p], "key_b": kb[q], "distance": np.sqrt(((a[p] - b[q]) ** 2).sum(1))})

    pairs = tiled(points.withColumn("l", F.lit(True)).withColumn("r", F.lit(True)), radius, search, "key_a string, key_b string, distance double", tile_points)
    return pairs.groupBy("key_a", "key_b").agg(F.min("distance").alias("distance")) if repeated else pairs


def inside_regions(df: DataFrame, regions: DataFrame, key: str = "obs", x: str = "x", y: str = "y", region: str = "region_id", xs: str = "xs", ys: str = "ys", cell: float | None = None) -> DataFrame:
    """(key, region) for every region that contains the point; the boundary belongs to a region.

    Regions descend a quadtree to nodes: a node wholly inside is accepted without looking at its points; nodes of the finest
    cells on the boundary carry the edges that decide there, and are refined by the even-odd rule. Rings with fewer than three
    vertices, with unequal numbers of xs and ys, or with null or infinite vertices contain nothing. The join is on nodes, which
    are broadcast up to ``NODES`` of them and shuffled beyond; the finest cell is a twentieth of the mean extent of the regions
    unless given."""
    points = _clean(df, key, x, y, [])
    c = lambda n: F.col(f"`{n}`")
    rings = regions.select(c(region).cast("string").alias("r"), c(xs).cast("array<double>").alias("xs"), c(ys).cast("array<double>").alias("ys")).filter("r is not null and size(xs) >= 3 and size(xs) = size(ys)").filter(~F.exists(F.concat("xs", "ys"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    if cell is None:
        extent = rings.agg(F.avg(F.greatest(F.array_max("xs") - F.array_min("xs"), F.array_max("ys") - F.array_min("ys")))).first()[0]
        cell = (extent or 20.0) / 20

    def nodes(batches):
        for pdf in batches:
            for r, a, b in zip(pdf["r"], pdf["xs"], pdf["ys"]):
                found = cover(a, b, cell)
                while part := list(islice(found, 1024)):
                    rows = [(r, level, ix, iy, *([None] * 4 if edges is None else [e.tolist() for e in edges])) for level, ix, iy, edges in part]
                    yield pd.DataFrame(rows, columns=["r", "level", "nx", "ny", "x1", "y1", "x2", "y2"])

    covered = cut(rings.mapInPandas(nodes, "r string, level int, nx long, ny long, x1 array<double>, y1 array<double>, x2 array<double>, y2 array<double>"))
    levels = sorted(r[0] for r in covered.select("level").distinct().collect())  # at most as many as a quadtree is deep
    weight = covered.agg(F.sum(1 + F.coalesce(F.size("x1"), F.lit(0)))).first()[0] or 0
    side = lambda k: F.lit(cell) * F.pow(F.lit(2.0), k)
    on = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    on = on.withColumn("nx", F.floor(F.col("x") / side(F.col("level")))).withColumn("ny", F.floor(F.col("y") / side(F.col("level"))))
    on = on.join(F.broadcast(covered) if weight <= NODES else covered.hint("merge"), ["level", "nx", "ny"])

    def edge(i):
        x1, y1, x2, y2 = (F.get(F.col(n), i) for n in ("x1", "y1", "x2", "y2"))
        px, py = F.col("x"), F.col("y")
        spans = (y1 > py) != (y2 > py)
        crossing = spans & (px < F.when(spans, (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1))
        on_it = ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
        return F.when(on_it, F.lit(1_000_001)).when(crossing, F.lit(1)).otherwise(F.lit(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("x1") - 1), edge), F.lit(0).cast("long"), lambda a, b: a + b)
    hit = F.when(F.col("x1").isNull(), F.lit(True)).when(F.size("x1") == 0, F.lit(False)).otherwise((total >= 1_000_000) | (total % 2 == 1))
    return on.filter(hit).select(F.col("k").alias("key"), F.col("r").alias("region")).distinct()


RESULT = T.StructType([T.StructField(n, T.StringType()) for n in ("relation", "key_a", "key_b")])


def neighbourhood(obs: DataFrame, regions: DataFrame, radius: float = 12.5) -> DataFrame:
    """(relation, key_a, key_b) of problem 3: 'near' pairs within a sample and section, 'inside' regions, over current rows."""
    now = cut(latest(obs.select("obs", "sample", "section", "x", "y", "loaded_at"), "obs", "loaded_at").filter("sample is not null"))
    near = near_pairs(now, radius, groups=("sample", "section")).select(F.lit("near").alias("relation"), "key_a", "key_b")
    inside = inside_regions(now, regions).select(F.lit("inside").alias("relation"), F.col("key").alias("key_a"), F.col("region").alias("key_b"))
    return near.unionByName(inside)
