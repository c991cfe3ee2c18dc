"""Clusters of similar vectors, with their sizes, prevailing labels and most typical members.

Rows become directions (square roots of their shares, so Euclidean distance is Hellinger distance). Every partition
grows a cluster-feature tree: entries hold count, linear sum and squared sum; a row descends to the nearest entry of each
node, joins its leaf if the leaf's radius stays within the threshold, else it opens a leaf; full nodes split; when leaves
are too many the threshold rises and the closest leaves merge. Leaf summaries are mergeable: a tree of reductions brings ``fanout`` sets of leaves to one set of
the same bounded size, by Ward's criterion, until one set is left; Ward agglomeration of that one gives the
clusters, and one full pass assigns every row to the nearest centroid. What reaches the driver is one set of leaves.

Defined results: see ``vectors.dense`` for null, missing and repeated rows. With fewer distinct rows than clusters,
there are fewer clusters. Clusters are numbered from 0 by falling size of their leaves. An empty input has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.vectors import DIMENSIONS, block, stack
from lodestone.runtime import cut

LEAVES = 384
FANOUT = 8
#: Most entries of a node.
BRANCH = 32


def directions(x: np.ndarray) -> np.ndarray:
    root = np.sign(x) * np.sqrt(np.abs(x))
    return (root / np.maximum(np.sqrt(np.abs(x).sum(1, keepdims=True)), 1e-30)).astype(np.float64)


def ward(n: np.ndarray, s: np.ndarray, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster features (counts, linear sums, squared sums) agglomerated to ``keep`` by the least growth of squared error."""
    m = len(n)
    if m <= keep:
        return n, s, q
    n, s, q = n.astype(float).copy(), s.copy(), q.astype(float).copy()
    c = s / n[:, None]
    sq = (c * c).sum(1)
    cost = np.maximum(sq[:, None] + sq[None] - 2 * c @ c.T, 0) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(cost, np.inf)
    best, least = cost.argmin(1), cost.min(1)
    alive = np.ones(m, bool)
    for _ in range(m - keep):
        i = int(least.argmin())
        j = int(best[i])
        # Lance-Williams update of row i, then row j leaves
        ni, nj = n[i], n[j]
        row = ((n + ni) * cost[i] + (n + nj) * cost[j] - n * cost[i, j]) / (n + ni + nj)
        n[i], s[i], q[i] = ni + nj, s[i] + s[j], q[i] + q[j]
        alive[j] = False
        row[~alive], row[i] = np.inf, np.inf
        cost[i], cost[:, i], cost[j], cost[:, j] = row, row, np.inf, np.inf
        least[j] = np.inf
        stale = alive & ((best == i) | (best == j))
        stale[i] = True
        for r in np.flatnonzero(stale):
            best[r] = cost[r].argmin()
            least[r] = cost[r, best[r]]
        nearer = alive & (row < least)
        best[nearer], least[nearer] = i, row[nearer]
    return n[alive], s[alive], q[alive]


class Node:
    """Entries of a cluster-feature tree: counts, linear sums and squared sums of leaves or of the nodes below."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, kids: list[Node] | None = None):
        self.n, self.s, self.q, self.kids = n, s, q, kids

    def insert(self, n: np.ndarray, s: np.ndarray, q: np.ndarray, limit: float) -> list[Node]:
        """Adds features below the entries they are nearest to; the node in parts of at most ``BRANCH`` entries."""
        if len(self.n):
            c = self.s / self.n[:, None]
            to = ((c * c).sum(1) - 2 * (s / n[:, None]) @ c.T).argmin(1)
        if self.kids is None:
            if len(self.n):
                m, t, u = self.n[to] + n, self.s[to] + s, self.q[to] + q
                joins = u / m - (t * t).sum(1) / m**2 <= limit
                for mine, other in ((self.n, n), (self.s, s), (self.q, q)):
                    np.add.at(mine, to[joins], other[joins])
                n, s, q = n[~joins], s[~joins], q[~joins]
            self.n, self.s, self.q = np.concatenate([self.n, n]), np.concatenate([self.s, s]), np.concatenate([self.q, q])
        else:
            kids = []
            for k, kid in enumerate(self.kids):
                mine = to == k
                kids += kid.insert(n[mine], s[mine], q[mine], limit) if mine.any() else [kid]
            self.kids = kids
            self.n, self.s, self.q = np.array([k.n.sum() for k in kids]), np.stack([k.s.sum(0) for k in kids]), np.array([k.q.sum() for k in kids])
        return self.parts()

    def parts(self) -> list[Node]:
        """Splits the node at the two entries furthest apart as long as it has too many."""
        if len(self.n) <= BRANCH:
            return [self]
        c = self.s / self.n[:, None]
        a = int(((c - c[0]) ** 2).sum(1).argmax())
        far = ((c - c[a]) ** 2).sum(1)
        side = ((c - c[int(far.argmax())]) ** 2).sum(1) < far
        if not side.any() or side.all():  # all alike
            side = np.arange(len(c)) % 2 == 0
        halves = [Node(self.n[h], self.s[h], self.q[h], None if self.kids is None else [k for k, x in zip(self.kids, h) if x]) for h in (side, ~side)]
        return [p for h in halves for p in h.parts()]

    def leaves(self) -> list[Node]:
        return [self] if self.kids is None else [leaf for k in self.kids for leaf in k.leaves()]


class FeatureTree:
    """A cluster-feature tree of one partition. A row descends to the nearest entry of every node; it joins its leaf if the leaf's
    radius stays within the threshold, else it opens one; a node with too many entries splits. When leaves are too many the
    threshold rises and the tree is built again from its merged leaves."""

    def __init__(self, size: int, leaves: int = LEAVES):
        self.most, self.limit, self.size = leaves, 0.0, size
        self.root = Node(np.zeros(0), np.zeros((0, size)), np.zeros(0))

    def insert(self, x: np.ndarray) -> None:
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            self._add(np.ones(len(part)), part.copy(), (part * part).sum(1))
            n, s, q = self._all()
            if len(n) > 2 * self.most:
                n, s, q = ward(n, s, q, self.most)
                # the threshold rises to what the merged leaves need
                self.limit = max(self.limit, float(np.median(q / n - ((s / n[:, None]) ** 2).sum(1))) * 1.1)
                self.root = Node(np.zeros(0), np.zeros((0, self.size)), np.zeros(0))
                self._add(n, s, q)

    def _add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        if not len(n):
            return
        nodes = self.root.insert(n, s, q, self.limit)
        while len(nodes) > 1:
            nodes = Node(np.array([k.n.sum() for k in nodes]), np.stack([k.s.sum(0) for k in nodes]), np.array([k.q.sum() for k in nodes]), nodes).parts()
        self.root = nodes[0]

    def _all(self):
        parts = self.root.leaves()
        return np.concatenate([p.n for p in parts]), np.concatenate([p.s for p in parts]), np.concatenate([p.q for p in parts])

    def depth(self) -> int:
        node, d = self.root, 1
        while node.kids is not None:
            node, d = node.kids[0], d + 1
        return d

    def features(self):
        return ward(*self._all(), self.most)


def _rows(n, s, q, group: int) -> pd.DataFrame:
    return pd.DataFrame({"g": np.full(len(n), group), "n": n, "s": [r.astype(np.float64).tobytes() for r in s], "q": q})


SCHEMA = "g long, n double, s binary, q double"


def leaf_features(vectors: DataFrame, size: int) -> DataFrame:
    def grow(batches):
        tree = FeatureTree(size)
        for pdf in batches:
            for at in range(0, len(pdf), block(size)):
                tree.insert(directions(stack(pdf["v"].iloc[at : at + block(size)], size)))
        yield _rows(*tree.features(), 0) if len(tree._all()[0]) else _rows(np.zeros(0), np.zeros((0, size)), np.zeros(0), 0)

    return vectors.select("v").mapInPandas(grow, SCHEMA).withColumn("g", F.spark_partition_id().cast("long"))


def centroids(vectors: DataFrame, size: int, k: int) -> np.ndarray:
    """At most k centroids, by falling size."""
    vectors = vectors.repartition(max(1, vectors.sparkSession.sparkContext.defaultParallelism), F.xxhash64("k"))
    leaves = cut(leaf_features(vectors, size))
    parts, fanout = leaves.agg(F.max("g")).first()[0], max(2, FANOUT * DIMENSIONS // max(size, DIMENSIONS))
    while parts:

        def reduce(pdf):
            s = np.frombuffer(b"".join(pdf["s"]), np.float64).reshape(len(pdf), size)
            return _rows(*ward(pdf["n"].to_numpy(), s, pdf["q"].to_numpy(), LEAVES), int(pdf["g"].iloc[0]))

        leaves = cut(leaves.withColumn("g", F.floor(F.col("g") / fanout)).groupBy("g").applyInPandas(reduce, SCHEMA))
        parts //= fanout
    last = leaves.toPandas()
    if not len(last):
        return np.zeros((0, size))
    n, s, _ = ward(last["n"].to_numpy(), np.frombuffer(b"".join(last["s"]), np.float64).reshape(len(last), size), last["q"].to_numpy(), k)
    return (s / n[:, None])[np.argsort(-n, kind="stable")]


def assign(vectors: DataFrame, size: int, k: int) -> DataFrame:
    """(k, cluster, distance) of every vector."""
    vectors = cut(vectors)
    c = centroids(vectors, size, k)
    if not len(c):
        return vectors.select("k", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")).limit(0)
    square = (c * c).sum(1)

    def nearest(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2 * block(size)):
                p = pdf.iloc[at : at + 2 * block(size)]
                x = directions(stack(p["v"], size))
                d = square - 2 * x @ c.T
                to = d.argmin(1)
                far = np.sqrt(np.maximum(0, d[np.arange(len(p)), to] + (x * x).sum(1)))
                yield pd.DataFrame({"k": p["k"], "cluster": to.astype(np.int32), "distance": far})

    return vectors.mapInPandas(nearest, "k string, cluster int, distance double")


def plain(label):
    """Labels equal up to case, spaces, hyphens and underscores."""
    return F.nullif(F.regexp_replace(F.lower(label), r"[\s\p{Z}_-]+", ""), F.lit(""))


def describe(assigned: DataFrame, labels: DataFrame, categories: DataFrame, typical: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, clusters): assigned rows with their label, and for each cluster its size, the label that most labelled
    members have (as ``categories`` spells it; the first in order among equals) and its most typical members."""
    named = categories.select(plain(F.col("annotation_key")).alias("p"), F.col("annotation_key").alias("name")).filter("p is not null").groupBy("p").agg(F.min("name").alias("name"))
    members = assigned.join(labels.select("k", F.lit(True).alias("listed"), plain(F.col("label")).alias("p"), "label"), "k", "left")
    votes = members.filter("p is not null").groupBy("cluster", "p").agg(F.count("*").alias("n"))
    votes = votes.join(F.broadcast(named), "p")  # one row for each category
    most = votes.groupBy("cluster").agg(F.min_by(F.struct("name", "p"), F.struct(-F.col("n"), "name")).alias("m")).select("cluster", "m.name", "m.p")
    # typical members: the nearest of each of many parts, then the nearest of those
    part = F.pmod(F.xxhash64("k"), F.lit(64))
    order = [F.col("distance"), F.col("k")]
    near = assigned.withColumn("r", F.row_number().over(Window.partitionBy("cluster", part).orderBy(*order))).filter(F.col("r") <= typical)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).filter(F.col("r") <= typical)
    near = near.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "k"))), lambda x: x["k"]).alias("typical_members"))
    clusters = assigned.groupBy("cluster").agg(F.count("*").alias("members")).join(most, "cluster", "left").join(near, "cluster")
    return members, clusters.select("cluster", "members", F.col("name").alias("prevailing_label"), "typical_members", "p")
