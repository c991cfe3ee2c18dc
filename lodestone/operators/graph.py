"""Connected components, spectral clustering, regions and segments on edge lists (i, j, w)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.elementwise import in_ranges
from lodestone.operators.spatial import affinity, nearest_labelled, sparse_distances, with_annotation
from lodestone.runtime import cut, partitions, plain_plans

#: Rows of links and nodes of one task, and most nodes of components that are split together.
BIN, STACKED = 131_072, 256

def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest name of a component. Alternates large-star and small-star steps on the edges until
    nothing changes; every step is a join-free aggregation whose group members are exploded again."""
    e = edges.select(F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j")).filter("i is not null and j is not null")
    links = cut(e.filter("i <> j").select(F.least("i", "j").alias("b"), F.greatest("i", "j").alias("a")).distinct())
    total = None
    while True:
        # large star: greater neighbours go to the least of the neighbourhood
        both = links.union(links.select(F.col("a").alias("b"), F.col("b").alias("a")))  # (b, a): a's neighbour b
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("v > u").join(least, "u").select(F.col("m").alias("b"), F.col("v").alias("a")).filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(small, "u")
        new = cut(joined.select(F.col("m").alias("b"), F.col("v").alias("a")).union(joined.select(F.col("m").alias("b"), F.col("u").alias("a"))).filter("a <> b").distinct())
        check = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        links = new
        if total == tuple(check):
            break
        total = tuple(check)
    own = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    every = (nodes.select(F.col(nodes.columns[0]).cast("string").alias("node")) if nodes is not None else e.select(F.col("i").alias("node")).union(e.select("j"))).distinct()
    return every.join(own, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _bisect(w: np.ndarray, threshold: float, dim: int, max_size: int | None, min_size: int, xy: np.ndarray | None = None, reach: float | None = None, aspect: float | None = None) -> np.ndarray:
    """Labels of the parts of a connected graph: halves it by the second eigenvector as long as a part is too large, too wide or too
    long, or the cut is cheap for its size (relative to the surface of a compact body of that dimension)."""
    label, todo, done = np.zeros(len(w), int), [np.arange(len(w))], 0
    while todo:
        part = todo.pop()
        sub = w[np.ix_(part, part)]
        split = None
        if len(part) >= 2 * min_size and len(part) > 1:
            degree = np.maximum(sub.sum(1), 1e-12)
            s = sub / np.sqrt(degree[:, None] * degree)
            vector = np.linalg.eigh(s)[1][:, -2] / np.sqrt(degree)
            order = np.sort(vector)
            side = vector > (0 if (vector > 0).any() and (vector <= 0).any() else order[len(order) // 2])
            if min(side.sum(), (~side).sum()) >= min_size:
                cost = sub[np.ix_(side, ~side)].sum() / max(sub.sum() / 2, 1e-12)
                compact = 1 / (1 + 2 * dim * ((len(part) / 2) ** (1 / dim) - 1)) if len(part) > 2 else 1.0
                shape = xy is not None and len(part) > 2 and _stretched(xy[part], reach, aspect)
                if cost / max(compact, 1e-12) <= threshold or (max_size and len(part) > max_size) or shape:
                    split = side
        if split is None:
            label[part] = done
            done += 1
        else:
            todo += [part[split], part[~split]]
    return label


def _bisect_all(c: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, threshold: float, dim: int, max_size: int | None, min_size: int, xy: np.ndarray, reach: float | None = None, aspect: float | None = None) -> np.ndarray:
    """Labels, unique over all, of the parts of every component (numbered by node, ``c``) of the links (i, j, w), as by ``_bisect``.
    Parts of one size are halved together, from the largest down, as halves are smaller; components of more than
    ``STACKED`` nodes one after the other."""
    size = np.bincount(c)
    nodes = np.argsort(c, kind="stable")
    start = np.cumsum(size) - size
    local = np.empty(len(c), int)
    local[nodes] = np.arange(len(c)) - np.repeat(start, size)
    order = np.argsort(size[c[i]], kind="stable")
    i, j, w = i[order], j[order], w[order]
    label, done, pending = np.zeros(len(c), int), 0, {}
    sizes = size[c[i]]
    slot = np.zeros(len(size), int)
    for k in range(int(size.max(initial=0)), 0, -1):
        own = np.flatnonzero(size == k)
        e = slice(*np.searchsorted(sizes, [k, k + 1])) if len(own) else slice(0, 0)
        slot[own] = np.arange(len(own))
        at = nodes[start[own][:, None] + np.arange(k)]
        if k > STACKED:
            ends = np.argsort(slot[c[i[e]]], kind="stable")
            for each, links in zip(at, np.split(ends, np.cumsum(np.bincount(slot[c[i[e]]], minlength=len(own)))[:-1])):
                m = np.zeros((k, k))
                np.maximum.at(m, (local[i[e]][links], local[j[e]][links]), w[e][links])
                parts = _bisect(np.maximum(m, m.T), threshold, dim, max_size, min_size, xy[each], reach, aspect)
                label[each] = done + parts
                done += parts.max() + 1
            continue
        stacks = pending.pop(k, [])
        if len(own):
            m = np.zeros((len(own), k, k))
            np.maximum.at(m, (slot[c[i[e]]], local[i[e]], local[j[e]]), w[e])
            stacks.append((np.maximum(m, m.transpose(0, 2, 1)), at))
        step = max(1, STACKED**2 * 16 // k**2)
        for m, at in ((m[a : a + step], at[a : a + step]) for m, at in stacks for a in range(0, len(at), step)):
            side = _halves_of(m, threshold, dim, max_size, min_size, xy[at], reach, aspect)
            n = side.sum(1)
            whole = n == 0
            label[at[whole]] = (done + np.arange(whole.sum()))[:, None]
            done += whole.sum()
            for half, count in ((side, n), (~side, k - n)):
                place = np.argsort(~half, axis=1, kind="stable")
                for a in np.unique(count[~whole]):
                    r = np.flatnonzero(~whole & (count == a))
                    q = place[r, :a]
                    pending.setdefault(int(a), []).append((m[r[:, None, None], q[:, :, None], q[:, None, :]], at[r[:, None], q]))
    return label


def _halves_of(m: np.ndarray, threshold: float, dim: int, max_size: int | None, min_size: int, xy: np.ndarray, reach: float | None, aspect: float | None) -> np.ndarray:
    """Which nodes are in the first half of each of a stack of graphs of one size; none where the graph stays whole."""
    k = m.shape[1]
    if k < 2 * min_size or k < 2:
        return np.zeros(m.shape[:2], bool)
    degree = np.maximum(m.sum(2), 1e-12)
    vector = np.linalg.eigh(m / np.sqrt(degree[:, :, None] * degree[:, None, :]))[1][:, :, -2] / np.sqrt(degree)
    signs = (vector > 0).any(1) & (vector <= 0).any(1)
    side = vector > np.where(signs, 0, np.sort(vector, axis=1)[:, k // 2])[:, None]
    cost = np.einsum("nij,ni,nj->n", m, side * 1.0, ~side * 1.0) / np.maximum(m.sum((1, 2)) / 2, 1e-12)
    compact = 1 / (1 + 2 * dim * ((k / 2) ** (1 / dim) - 1)) if k > 2 else 1.0
    split = (cost / max(compact, 1e-12) <= threshold) | bool(max_size and k > max_size)
    if k > 2 and (reach is not None or aspect is not None):
        split |= np.array([_stretched(p, reach, aspect) for p in xy])
    least = np.minimum(side.sum(1), k - side.sum(1))
    return side & (split & (least >= max(1, min_size)))[:, None]


def _stretched(xy: np.ndarray, reach: float | None, aspect: float | None) -> bool:
    if reach is not None and np.ptp(xy, axis=0).max() > reach:
        return True
    if aspect is None:
        return False
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(xy.T)), 0))
    return bool(values[-1] > aspect * max(values[0], 1e-12))


def spectral_clustering(edges: DataFrame, nodes: DataFrame, max_size: int | None = None, min_size: int = 1, dim: int = 2, cut_threshold: float = 0.7, largest: int = 4000, rounds: int = 30, positions: DataFrame | None = None, position_range: float | None = None, max_aspect_ratio: float | None = None) -> DataFrame:
    """(node, cluster), named by the smallest node. Connected components are split by normalised cuts, many in a task.

    Components of more than ``largest`` nodes are halved first, all at once and as often as it takes: the second eigenvector
    comes from ``rounds`` power steps, joins of the edge table, and its sign halves the component (its median where one side
    has less than a hundredth); halves that fall apart are components of their own. With ``positions`` (node, x, y), parts wider
    than ``position_range``, or longer than ``max_aspect_ratio`` times their width, are split too."""
    names = lambda c: F.col(c).cast("string").alias(c)
    way = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "w")
    links = edges.select(names("i"), names("j"), F.col("w").cast("double").alias("w")).filter("i is not null and j is not null and i <> j and w > 0")
    links = cut(links.select(F.inline(F.array(way("i", "j"), way("j", "i")))).groupBy("i", "j").agg(F.max("w").alias("w")))
    every = nodes.select(F.col(nodes.columns[0]).cast("string").alias("node")).filter("node is not null").distinct()
    comp = cut(connected_components(links, every))
    while True:
        big = comp.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > largest)
        if not big.take(1):
            break
        comp = cut(_halved(links, comp, cut(big.select("component")), rounds))
        inside = links.join(comp.select(F.col("node").alias("i"), F.col("component").alias("a")), "i").join(comp.select(F.col("node").alias("j"), F.col("component").alias("b")), "j").filter("a = b").select("i", "j", "w")
        links = cut(inside)
        comp = cut(connected_components(links, every))
    e = links.join(comp.withColumnRenamed("node", "i"), "i")
    both = comp.select("component", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("w")).unionByName(e.select("component", "i", "j", "w"))
    at = positions.select(F.col(positions.columns[0]).cast("string").alias("i"), "x", "y") if positions is not None else None
    both = both.join(at, "i", "left") if at is not None else both.withColumn("x", F.lit(0.0)).withColumn("y", F.lit(0.0))
    shape = (position_range, max_aspect_ratio) if positions is not None else (None, None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, i = np.unique(pdf["i"].to_numpy(object), return_inverse=True)
        j = pd.Index(found).get_indexer(pdf["j"])
        c, xy = np.zeros(len(found), int), np.zeros((len(found), 2))
        c[i] = pd.factorize(pdf["component"])[0]
        xy[i] = pdf[["x", "y"]].to_numpy(float)
        linked = i != j
        label = _bisect_all(c, i[linked], j[linked], pdf["w"].to_numpy(float)[linked], cut_threshold, dim, max_size, min_size, np.nan_to_num(xy), *shape)
        first = np.full(len(found), len(found))
        np.minimum.at(first, label, np.arange(len(found)))
        return pd.DataFrame({"node": found, "cluster": found[first[label]]})

    # a task takes many components: most have a few nodes
    bins = max(partitions(links.sparkSession), (links.count() + comp.count()) // BIN)
    return both.groupBy(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin")).applyInPandas(run, "node string, cluster string")


def _halved(links: DataFrame, comp: DataFrame, big: DataFrame, rounds: int) -> DataFrame:
    """``comp`` with the large components cut in two by the sign of the second eigenvector of their normalised links."""
    inner = comp.join(big, "component", "left_semi")
    e = links.join(inner.select(F.col("node").alias("i"), "component"), "i")
    degree = e.groupBy("i").agg(F.sum("w").alias("d"))
    e = cut(e.join(degree, "i").select("i", "j", (F.col("w") / F.col("d")).alias("p")))
    start = (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) - 0.5).alias("v")
    v = cut(inner.join(degree.withColumnRenamed("i", "node"), "node").select("node", "component", "d", start))
    share = lambda c: F.sum(F.col("d") * F.col(c)) / F.sum("d")
    for k in range(rounds):
        # half a step of the random walk, freed of the constant vector
        step = e.join(v.select(F.col("node").alias("j"), "v"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("p") * F.col("v")).alias("u"))
        v = cut(v.join(step, "node").select("node", "component", "d", ((F.col("v") + F.col("u")) / 2).alias("v")))  # used twice a round
        if k % 10 == 9 or k == rounds - 1:
            mean = v.groupBy("component").agg(share("v").alias("m"), F.max(F.abs("v")).alias("s"))
            v = cut(v.join(F.broadcast(mean), "component").select("node", "component", "d", ((F.col("v") - F.col("m")) / F.greatest("s", F.lit(1e-300))).alias("v")))  # large components only: few
    sides = v.groupBy("component").agg(F.percentile_approx("v", 0.5).alias("middle"), F.avg((F.col("v") > 0).cast("double")).alias("up"))
    cuts = sides.select("component", F.when(F.col("up").between(0.01, 0.99), 0.0).otherwise(F.col("middle")).alias("c"))
    side = v.join(F.broadcast(cuts), "component").select("node", (F.col("v") > F.col("c")).alias("up"))
    return comp.join(side, "node", "left").select("node", F.concat("component", F.when(F.col("up"), "+").when(~F.col("up"), "-").otherwise("")).alias("component"))


def segment(molecules: DataFrame, distance_scale: float, max_size: int | None = None, max_distance: float | None = None, annotation: DataFrame | None = None, annotation_distance: float | None = None, **kw) -> DataFrame:
    """(node, cluster): molecules (obs, x, y) in cells: radius graph, optionally apart by label, affinities, spectral clustering."""
    d = sparse_distances(molecules, max_distance or 2 * distance_scale)
    if annotation is not None and annotation_distance:
        d = with_annotation(d, annotation, annotation_distance)
    return spectral_clustering(affinity(d, distance_scale), molecules.select("obs"), max_size, **kw)


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, rounds: int = 4, levels: int = 2) -> DataFrame:
    """(node, community): parts of a weighted undirected graph (i, j, w; both directions) of high modularity, named by their least node.

    In every round half of the nodes, by a hash, go to the community of a neighbour where the modularity grows most; when nothing
    moves (or after ``rounds``), communities become nodes, at most ``levels`` times in all: parts stay finer than where modularity
    is greatest. Rounds are joins and aggregations of the edge table."""
    names = lambda c: F.col(c).cast("string").alias(c)
    e = cut(edges.select(names("i"), names("j"), F.col("w").cast("double").alias("w")).filter("i is not null and j is not null and w > 0").groupBy("i", "j").agg(F.sum("w").alias("w")))
    where = cut(nodes.select(F.col(nodes.columns[0]).cast("string").alias("node")).filter("node is not null").distinct().withColumn("community", F.col("node")))
    total = e.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return where
    for _ in range(levels):
        degree = cut(e.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("d")))
        at = cut(degree.select("node", F.col("node").alias("c"), "d"))
        changed, quiet = 0, 0
        for k in range(rounds):
            size = at.groupBy("c").agg(F.sum("d").alias("t"))
            # links of a node to the communities of its neighbours, not counting those to itself
            links = e.filter("i <> j").join(at.select(F.col("node").alias("j"), "c"), "j").groupBy("i", "c").agg(F.sum("w").alias("w"))
            own = at.select(F.col("node").alias("i"), F.col("c").alias("own"), "d")
            gain = links.join(own, "i").join(size, "c").withColumn("g", F.col("w") - resolution * F.col("d") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)) / total)
            stay = gain.groupBy("i").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("g"))).alias("s"), F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("b"), F.first("own").alias("own"), F.first("d").alias("d"))
            alone = size.select(F.col("c").alias("own"), F.col("t").alias("mine"))
            stay = stay.join(alone, "own").withColumn("s", F.coalesce("s", -resolution * F.col("d") * (F.col("mine") - F.col("d")) / total))
            moves = stay.filter((-F.col("b.g") > F.col("s") + 1e-12) & (F.pmod(F.xxhash64("i", F.lit(k // 2)), F.lit(2)) == k % 2)).select(F.col("i").alias("node"), F.col("b.c").alias("to"))
            new = cut(at.join(moves, "node", "left").select("node", F.coalesce("to", "c").alias("c"), "d", F.col("to").isNotNull().alias("moved")))
            n = new.agg(F.count_if("moved")).first()[0]
            at, changed, quiet = new.drop("moved"), changed + n, 0 if n else quiet + 1
            if quiet > 1:
                break
        where = cut(where.join(at.select(F.col("node").alias("community"), "c"), "community", "left").select("node", F.coalesce("c", "community").alias("community")))
        if not changed:
            break
        part = at.select("node", "c")
        e = cut(e.join(part.select(F.col("node").alias("i"), F.col("c").alias("a")), "i").join(part.select(F.col("node").alias("j"), F.col("c").alias("b")), "j").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("w")))
    least = where.groupBy("community").agg(F.min("node").alias("first"))
    return where.join(least, "community").select("node", F.col("first").alias("community"))


def label_neighbours(weights: DataFrame, k: int) -> DataFrame:
    """(i, j): observations near each other in label space, over all batches: those of one strongest label, in order of its weight
    (equals by a hash), are linked to the k / 2 next ones on either side. Ranks are counted in ranges."""
    strong = weights.groupBy("obs").agg(F.max(F.struct("weight", "category")).alias("b")).select(F.col("obs").cast("string").alias("obs"), F.struct("b.category", F.round("b.weight", 6).alias("w"), F.xxhash64("obs").alias("h"), F.col("obs").cast("string").alias("o")).alias("key"))
    parts = in_ranges(strong, "key")
    run = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = parts.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", run - F.col("_c")).drop("_c")  # a row a range
    ranked = cut(parts.join(F.broadcast(before), "_p").select("obs", F.col("key.category").alias("c"), (F.col("_b") + F.col("_k")).alias("r")))
    ahead = ranked.select(F.col("obs").alias("i"), F.col("c").alias("ci"), F.explode(F.sequence(F.col("r") + 1, F.col("r") + max(1, k // 2))).alias("r"))
    half = ahead.join(ranked.select(F.col("obs").alias("j"), "c", "r"), "r").filter("c = ci").select("i", "j")
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j")))


def find_regions(points: DataFrame, weights: DataFrame, k: int = 15, position_weight: float = 3.0, group: str | None = None, resolution: float = 1.0, annotation_connectivity: DataFrame | None = None, position_connectivity: DataFrame | None = None, cross_batch_factor: float = 1.0) -> DataFrame:
    """(obs, region): communities of the joint graph of label and position, named by their least observation.

    Positions link each point to its k nearest within its batch (``group``), labels to its k neighbours in label space over all
    batches (or the given (i, j, w) tables do); both are made symmetric and each row sums to 1 at most, links between batches
    count ``cross_batch_factor`` times, and the graph is (1 - w) label + w position with w = position_weight / (1 + position_weight)."""
    fine = cut(points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)"))
    batch = fine.select(F.col("obs").cast("string").alias("node"), (F.col(group).cast("string") if group else F.lit("")).alias("g"))
    names = lambda c: F.col(c).cast("string").alias(c)

    def share(edges: DataFrame) -> DataFrame:
        both = edges.filter("i <> j").unionByName(edges.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
        return both.withColumn("w", F.col("w") / k)

    near = position_connectivity.select(names("i"), names("j"), "w") if position_connectivity is not None else nearest_labelled(fine, fine, k + 1, group).select("i", "j", F.lit(1.0).alias("w"))
    alike = annotation_connectivity.select(names("i"), names("j"), "w") if annotation_connectivity is not None else label_neighbours(weights.join(fine.select("obs"), "obs", "left_semi"), k).withColumn("w", F.lit(1.0))
    if cross_batch_factor != 1:
        alike = alike.join(batch.select(F.col("node").alias("i"), F.col("g").alias("gi")), "i").join(batch.select(F.col("node").alias("j"), F.col("g").alias("gj")), "j").select("i", "j", (F.col("w") * F.when(F.col("gi") == F.col("gj"), 1.0).otherwise(cross_batch_factor)).alias("w"))
    w = position_weight / (1 + position_weight)
    graph = share(near).withColumn("w", F.col("w") * w).unionByName(share(alike).withColumn("w", F.col("w") * (1 - w)))
    with plain_plans(points.sparkSession):
        found = communities(graph, batch.select("node"), resolution)
    return found.select(F.col("node").alias("obs"), F.col("community").alias("region"))
