"""The most similar vectors of every vector, by cosine, from a hash-prefix forest.

Each tree is an array of hash strings, sorted. A string's symbols come from random rotations of the centred direction: the
axis it is closest to, and on which side; the first symbol of all dimensions (up to ``WIDE``), later ones of ``NARROW``. A
vector descends in every tree to the entries that share the longest prefix with it, and ascends in all trees in step, one
symbol at a time, until the entries that share the prefix number ``candidates`` in the trees together, or one symbol is left.
Only names and hash strings take part in this. Vectors are then sent once to each of their groups, where exact cosines
are computed: a group of more than ``BLOCK`` is compared block by block, so nothing is clipped, and a vector that finds
k candidates in none of the trees is compared with all vectors. ``exact`` gives the result by comparing all with all.

The number of trees and of candidates follow from the number n of vectors: with few, neighbours are further away and need
more trees; with many, prefixes are longer and need more again. The share of n that is compared falls as n grows.

Exact copies: of more than k + 1 equal vectors, the k + 1 smallest names stand for all in the forest; the neighbours
of the others are the k smallest names of their copies, at similarity 1, which is exact, ties going to smaller names.

Defined results: see ``vectors.dense`` for null, missing and repeated rows. Fewer than two vectors give no rows. Ties
go to the smaller name. The result is approximate in that a vector in none of the groups is missed; README.md has the
recall measured against brute force.

``alike`` finds the pairs beyond a similarity, each among the other's k most similar, without searching all neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.vectors import DIMENSIONS, Units, folded, unit
from lodestone.runtime import cut, partitions

SALTS = 64
#: Dimensions of the first symbol and of later ones, number of later ones, bits of each.
WIDE, NARROW, LATER = 96, 8, 8
BITS = (8, 4)
#: Vectors of a group that are compared at once; similarities held at once.
BLOCK, CELLS = 8192, 2_000_000
#: Bits of a symbol of ``Codes``, most symbols, trees they are tried out with, most trees, share of pairs just as similar as asked
#: for that may be missed, main axes of a sketch.
SYMBOL_BITS, SYMBOLS, TRIALS, TREES, MISS, SKETCH = 6, 8, 16, 200, 2e-4, (32, 64, 128)
#: About how many microseconds an entry, and the comparison of two sketches, takes; entries worked on at once and held by a task.
ENTRY_US, PAIR_US, CHUNK, HELD = 2.0, 0.05, 200_000, 500_000
#: Lists that a task merges.
ENTRIES = 200_000
PAIR = "array<struct<s:float,n:string>>"


def trees_for(n: int) -> int:
    return int(np.ceil(max(16, 34 * (3000 / max(n, 1000)) ** 0.15, 16 * (n / 300_000) ** 0.3)))


def candidates_for(n: int) -> int:
    return int(np.ceil(3 * max(n, 1) ** 0.7))


class Hashes:
    """Hash strings as integers that sort like them."""

    def __init__(self, size: int, mean: np.ndarray, trees: int, seed: int):
        d = min(size, DIMENSIONS)
        rng = np.random.default_rng(seed)
        self.size, self.mean, self.trees = size, mean, trees
        # many dimensions come down to a few hundred by one random projection
        self.down = rng.standard_normal((d, 256)).astype(np.float32) / 16 if d > 256 else None
        d = min(d, 256)
        self.wide, self.narrow = min(d, WIDE), min(d, NARROW)
        self.turn = []
        for _ in range(trees):
            q = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, : self.wide]]
            q += [np.linalg.qr(rng.standard_normal((d, self.narrow)))[0] for _ in range(LATER)]
            self.turn.append(np.hstack(q).astype(np.float32))

    def __call__(self, column: pd.Series) -> np.ndarray:
        x = unit(folded(column, self.size)) - self.mean
        x = x @ self.down if self.down is not None else x
        out = np.zeros((len(x), self.trees), np.int64)
        row = np.arange(len(x))
        for t, turn in enumerate(self.turn):
            y = x @ turn
            at = 0
            for width, bits in [(self.wide, BITS[0]), *[(self.narrow, BITS[1])] * LATER]:
                part = y[:, at : at + width]
                axis = np.abs(part).argmax(1)
                out[:, t] = (out[:, t] << bits) | (2 * axis + (part[row, axis] > 0))
                at += width
        return out


def _prefix(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The first ``level`` symbols."""
    return h >> (BITS[1] * (LATER + 1 - level))


def _moments(vec: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """(number, mean direction), added up by dimension."""

    def partial(batches):
        total, n = np.zeros(min(size, DIMENSIONS)), 0
        for pdf in batches:
            total += unit(folded(pdf["v"], size)).sum(0, dtype=np.float64)
            n += len(pdf)
        yield pd.DataFrame({"i": np.arange(-1, len(total)), "s": np.concatenate([[n], total])})

    rows = vec.mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one row a dimension
    s = {r["i"]: r["s"] for r in rows}
    n = int(s.get(-1, 0))
    return n, (np.array([s[i] for i in range(min(size, DIMENSIONS))]) / max(n, 1)).astype(np.float32) if n else np.zeros(min(size, DIMENSIONS), np.float32)


def _best(x: Units, names: pa.Array, asks: np.ndarray, member: np.ndarray, group: np.ndarray, k: int, even: bool = False) -> pa.Table:
    """(k, c): for each asker of each group, its k best members but for itself; even: as double precision and the names have it."""
    coded = names.dictionary_encode()
    code = coded.indices.to_numpy()
    if even:
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]]))
    askers, near, sims, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
    for a, b in zip(edge[:-1], edge[1:]):
        part = order[a:b]
        queries, members = part[asks[part]], part[member[part]]
        if not len(queries) or not len(members):
            continue
        top, step = min(k, len(members)), max(16, CELLS // len(members))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            sim = x.of(q, members)
            sim[code[q][:, None] == code[members]] = -2
            best = np.argpartition(sim, len(members) - top, axis=1)[:, len(members) - top :]
            askers.append(q)
            if even:
                # all that may be among the best at six digits, of which ties go to the smaller names
                least = np.take_along_axis(sim, best, 1).min(1, keepdims=True) - 2e-6
                row, best = np.nonzero(sim >= least)
                s = np.where(sim[row, best] > -2, x.pairs(q[row], members[best]), -2.0)
                first = np.lexsort([place[code[members[best]]], -np.round(s, 6), row])
                first = first[np.arange(len(row)) - np.searchsorted(row, row) < top]
                near.append(members[best[first]])
                sims.append(s[first])
            else:
                near.append(members[best].ravel())
                sims.append(np.take_along_axis(sim, best, 1).ravel())
            ends.append(np.full(len(q), top))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(ends))]).astype(np.int32)
    c = pa.StructArray.from_arrays([pa.array(np.concatenate(sims).astype(np.float64 if even else np.float32)), names.take(pa.array(np.concatenate(near)))], names=["s", "n"])
    return pa.table({"k": names.take(pa.array(np.concatenate(askers))), "c": pa.ListArray.from_arrays(pa.array(ends), c)})


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _lists(found: DataFrame, k: int, tasks: int, even: bool = False) -> DataFrame:
    """(k, neighbour, similarity, rank) of rows (k, c) with lists of neighbours; each neighbour once, ties at six digits to the smaller
    name; even: similarities with all digits."""

    def merge(t: pa.Table) -> pa.Table:
        keys, lists = t.column("k").combine_chunks().dictionary_encode(), t.column("c").combine_chunks()
        sims, names = lists.flatten().flatten()
        row = np.repeat(keys.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy())
        coded = names.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        s, name = np.round(sims.to_numpy().astype(float), 6), place[coded.indices.to_numpy()]
        order = np.lexsort([name, -s, row])
        order = order[s[order] > -2]
        first = np.sort(np.unique(row[order] * (len(place) + 1) + name[order], return_index=True)[1])
        order = order[first]
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, rank = order[rank < k], rank[rank < k]
        return pa.table({"k": keys.dictionary.take(pa.array(row[order])), "neighbour": names.take(pa.array(order)), "similarity": pa.array(np.minimum(1.0, sims.to_numpy()[order] if even else s[order])), "rank": pa.array((rank + 1).astype(np.int32))})

    return found.groupBy(F.pmod(F.xxhash64("k"), F.lit(tasks)).alias("task")).applyInArrow(merge, "k string, neighbour string, similarity double, rank int")


def exact(vectors: DataFrame, size: int, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """As ``nearest``, by comparing every vector (or those named in ``queries``) with all, in blocks."""
    vec = vectors if queries is None else vectors.join(queries.select("k").withColumn("q", F.lit(True)), "k", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    vec = cut(vec if "q" in vec.columns else vec.withColumn("q", F.lit(True)))
    n, asked = vec.agg(F.count("*"), F.count_if("q")).first()
    if not asked:
        return vec.sparkSession.createDataFrame([], "k string, neighbour string, similarity double, rank int")
    rows, columns = -(-asked // BLOCK), -(-n // BLOCK)
    h = F.xxhash64("k")
    row, column = F.pmod(h, F.lit(rows)).cast("int"), F.pmod(h, F.lit(columns)).cast("int")
    span = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    both = vec.filter("q").select("k", "v", row.alias("i"), F.explode(span(columns)).alias("j"), F.lit(True).alias("q")).unionByName(vec.select("k", "v", F.explode(span(rows)).alias("i"), column.alias("j"), F.lit(False).alias("q")))

    def compare(t: pa.Table) -> pa.Table:
        q = _column(t, "q").astype(bool)
        return _best(Units(t.column("v").to_pylist(), size), t.column("k").combine_chunks(), q, ~q, np.zeros(len(q), np.int64), k)

    return _lists(both.groupBy("i", "j").applyInArrow(compare, f"k string, c {PAIR}"), k, max(partitions(vec.sparkSession), asked * columns // ENTRIES))


def _copies(vec: DataFrame, k: int) -> tuple[DataFrame | None, DataFrame]:
    """(neighbours of the copies beyond the k + 1 smallest names of equal vectors, if any; the vectors without these)."""
    # only crowds of copies need care
    digest = vec.withColumn("h", F.md5("v"))
    crowds = cut(digest.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > k + 1))
    copies, active = None, vec
    if crowds.take(1):
        spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        crowded = digest.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(crowds.select("h", spread), ["h", "salt"], "left_semi")
        first = crowded.withColumn("r", F.row_number().over(Window.partitionBy("h", "salt").orderBy("k"))).filter(F.col("r") <= k + 1)
        first = cut(first.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("k"))).filter(F.col("r") <= k + 1).select("h", "k"))
        lists = first.groupBy("h").agg(F.slice(F.array_sort(F.collect_list("k")), 1, k).alias("c"))
        rest = crowded.join(first.select("k"), "k", "left_anti").join(lists.select("h", "c", spread), ["h", "salt"])
        copies = rest.select("k", F.posexplode("c").alias("rank", "neighbour")).select("k", "neighbour", F.lit(1.0).alias("similarity"), (F.col("rank") + 1).alias("rank"))
        active = cut(vec.join(rest.select("k"), "k", "left_anti"))
    return copies, active


def _found(entries: DataFrame, vectors: DataFrame, size: int, k: int, tasks: int, on: str = "k", even: bool = False) -> DataFrame:
    """Rows (k, c): the best of each group for each that asks; entries: (``on``, tree, level, p, asks), groups by (tree, level, p)."""
    groups = entries.groupBy("tree", "level", "p").agg(F.count("*").alias("m"), F.count_if("asks").alias("q")).filter("q > 0 and m > 1")
    # a group of more than BLOCK is compared block by block: its askers meet every block of its members
    groups = groups.select("tree", "level", "p", F.ceil(F.col("q") / BLOCK).cast("int").alias("bq"), F.ceil(F.col("m") / BLOCK).cast("int").alias("bm"))
    seated = entries.join(groups.hint("merge"), ["tree", "level", "p"])
    hash_ = F.xxhash64(on)
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    seat = lambda i, j, q, m: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), q.alias("asks"), m.alias("member"))
    one = (F.col("bq") == 1) & (F.col("bm") == 1)
    none = F.array().cast("array<struct<i:int,j:int,asks:boolean,member:boolean>>")
    as_member = F.transform(span("bq"), lambda i: seat(i, F.pmod(hash_, F.col("bm")), F.lit(False), F.lit(True)))
    as_asker = F.when(F.col("asks"), F.transform(span("bm"), lambda j: seat(F.pmod(hash_, F.col("bq")), j, F.lit(True), F.lit(False)))).otherwise(none)
    seats = F.when(one, F.array(seat(F.lit(0), F.lit(0), F.col("asks"), F.lit(True)))).otherwise(F.concat(as_member, as_asker))
    seated = seated.select(on, F.explode(seats).alias("s"), "tree", "level", "p").select(on, F.xxhash64("tree", "level", "p", "s.i", "s.j").alias("g"), "s.asks", "s.member")
    # vectors join once, with the list of their seats
    seated = seated.groupBy(on).agg(F.collect_list(F.struct("g", "asks", "member")).alias("s"))
    routed = vectors.join(seated, on).select("k", "v", F.explode("s").alias("s")).select("k", "v", "s.*")

    def compare(t: pa.Table) -> pa.Table:
        return _best(Units(t.column("v").to_pylist(), size), t.column("k").combine_chunks(), _column(t, "asks").astype(bool), _column(t, "member").astype(bool), _column(t, "g"), k, even)

    return routed.groupBy(F.pmod("g", F.lit(tasks)).alias("task")).applyInArrow(compare, f"k string, c {PAIR.replace('float', 'double') if even else PAIR}")


def nearest(vectors: DataFrame, size: int, k: int = 5, trees: int | None = None, candidates: int | None = None, seed: int = 7) -> DataFrame:
    """(k, neighbour, similarity, rank): the k most similar vectors of each vector of (k, v)."""
    vec = cut(vectors)
    n, mean = _moments(vec, size)
    trees, candidates = trees or trees_for(n), candidates or candidates_for(n)

    copies, active = _copies(vec, k)
    hashes = Hashes(size, mean, trees, seed)

    def sign(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                p = pdf.iloc[at : at + 4096]
                yield pd.DataFrame({"tree": np.tile(np.arange(trees, dtype=np.int32), len(p)), "h": hashes(p["v"]).ravel(), "k": np.repeat(p["k"].to_numpy(object), trees)})

    levels = LATER + 1
    strings = cut(active.mapInPandas(sign, "tree int, h long, k string"))
    # how many entries of a tree share 1, 2, ... symbols with each: counts of prefixes, longest first
    sizes = strings.select("tree", "h").groupBy("tree", "h").agg(F.count("*").alias("m"))

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "h"])
        tree, h, m = pdf["tree"].to_numpy(), pdf["h"].to_numpy(), pdf["m"].to_numpy()
        shares = np.zeros((len(pdf), levels), np.int64)
        for level in range(1, levels + 1):
            p = _prefix(h, level)
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (tree[1:] != tree[:-1])])
            run = np.cumsum(new) - 1
            shares[:, level - 1] = np.bincount(run, m)[run]
        return pd.DataFrame({"tree": tree, "h": h, "runs": list(shares)})

    first_symbol = F.shiftright("h", BITS[1] * LATER)
    profiles = cut(sizes.groupBy("tree", first_symbol.alias("p")).applyInPandas(descend, "tree int, h long, runs array<long>"))
    together = strings.join(profiles.hint("merge"), ["tree", "h"]).groupBy("k").agg(*[F.sum(F.col("runs")[i] - 1).alias(f"s{i + 1}") for i in range(levels)], F.max(F.col("runs")[0] - 1).alias("most"))
    # the longest prefix at which the trees together hold enough, else one symbol
    level = F.coalesce(*[F.when(F.col(f"s{i}") >= candidates, F.lit(i)) for i in range(levels, 0, -1)], F.lit(1))
    chosen = cut(together.select("k", level.alias("x"), (F.col("most") < k).alias("lonely")))
    used = sorted(r[0] for r in chosen.select("x").distinct().collect())  # at most as many as symbols

    entries = strings.join(chosen.select("k", "x"), "k").withColumn("level", F.explode(F.array(*[F.lit(i) for i in used]).cast("array<int>"))) if used else strings.withColumn("x", F.lit(1)).withColumn("level", F.lit(1))
    entries = entries.withColumn("p", F.expr(f"shiftright(h, {BITS[1]} * ({levels} - level))")).withColumn("asks", F.col("x") == F.col("level"))
    tasks = int(max(partitions(vec.sparkSession), n * trees * max(1, len(used)) // (4 * BLOCK)))
    found = _found(entries, active, size, k, tasks)
    merges = max(partitions(vec.sparkSession), n * trees // ENTRIES)
    lonely = chosen.filter("lonely").select("k")
    if lonely.take(1):
        alone = exact(active, size, k, lonely)
        found = found.join(lonely, "k", "left_anti")
        out = _lists(found, k, merges).unionByName(alone)
    else:
        out = _lists(found, k, merges)
    return out.unionByName(copies) if copies is not None else out


class Codes:
    """Codes of directions that are alike: a symbol is the axis of a random rotation that the centred direction is closest to, and
    on which side; a code is one tree's symbols. Besides its own code a direction gets those in which one of its two least
    certain symbols is replaced by its second choice."""

    def __init__(self, mean: np.ndarray, symbols: int, trees: int, seed: int):
        d, rng = len(mean), np.random.default_rng(seed)
        self.mean, self.symbols, self.trees = mean, symbols, trees
        self.down = rng.standard_normal((d, 256)).astype(np.float32) / 16 if d > 256 else None
        d = min(d, 256)
        self.width = min(d, 1 << (SYMBOL_BITS - 1))
        self.probes = 1 + (min(2, symbols) if self.width > 1 else 0)
        self.turn = [np.hstack([np.linalg.qr(rng.standard_normal((d, self.width)))[0] for _ in range(symbols)]).astype(np.float32) if symbols else None for _ in range(trees)]

    def choices(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, lead of the first) of each symbol in a tree."""
        z = x - self.mean
        z = z @ self.down if self.down is not None else z
        y = (z @ self.turn[tree]).reshape(len(x), self.symbols, self.width)
        size = np.abs(y)
        pick = lambda a, i: np.take_along_axis(a, i[..., None], 2)[..., 0]
        best = size.argmax(2)
        lead = pick(size, best)
        np.put_along_axis(size, best[..., None], -1, 2)
        next_ = size.argmax(2)
        symbol = lambda i: 2 * i + (pick(y, i) > 0)
        return symbol(best), symbol(next_), lead - pick(size, next_)

    def join(self, first: np.ndarray, second: np.ndarray, lead: np.ndarray, tree: int) -> np.ndarray:
        """(rows, codes) of choices."""
        n, symbols = first.shape
        if not symbols:
            return np.full((n, 1), tree, np.int64)
        shift = SYMBOL_BITS * np.arange(symbols)
        own = (first << shift).sum(1) | (tree << (SYMBOL_BITS * SYMBOLS))
        out = [own]
        if self.width > 1:
            change, row, least = (second << shift) - (first << shift), np.arange(n), np.argsort(lead, axis=1, kind="stable")
            out += [own + change[row, least[:, i]] for i in range(min(2, symbols))]
        return np.stack(out, 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees x probes)"""
        if not self.symbols:
            return np.zeros((len(x), 1), np.int64)
        return np.hstack([self.join(*self.choices(x, t), t) for t in range(self.trees)])


def fitting(sample: np.ndarray, n: int, least: float, seed: int) -> tuple[int, int]:
    """(symbols, trees) with which n directions like those of the sample take the least time, among those that miss at most
    ``MISS`` of the pairs that are just as similar as ``least``; no symbols: all are compared.

    How often such a pair has a code in common is tried out on the sample; rotations are random, so it only depends on how far
    a direction is from the mean, and is averaged over directions that are about as far."""
    rng = np.random.default_rng(seed)
    codes = Codes(sample.mean(0), SYMBOLS, TRIALS, seed + 1)
    aside = rng.standard_normal(sample.shape).astype(np.float32)
    aside = unit(aside - (aside * sample).sum(1, keepdims=True) * sample)
    other = least * sample + np.float32(np.sqrt(max(0.0, 1 - least * least))) * aside
    far = np.argsort(np.argsort(np.linalg.norm(sample - codes.mean, axis=1))) * min(16, len(sample)) // len(sample)
    met, chance = np.zeros((SYMBOLS + 1, len(sample))), np.zeros(SYMBOLS + 1)
    for t in range(TRIALS):
        a, b = codes.choices(sample, t), codes.choices(other, t)
        for s in range(1, SYMBOLS + 1):
            mine, theirs = codes.join(*[c[:, :s] for c in a], t), codes.join(*[c[:, :s] for c in b], t)
            met[s] += (mine[:, :, None] == theirs[:, None]).any((1, 2)) / TRIALS
            m = np.unique(mine, return_counts=True)[1].astype(float)
            chance[s] += ((m * (m - 1)).sum() + 1) / (len(sample) * max(1, len(sample) - 1)) / TRIALS
    d = min(sample.shape[1], 256)
    best = (ENTRY_US + n * max(PAIR_US / 2, 2e-4 * d), 0, 1)
    for s in range(1, SYMBOLS + 1):
        q = np.bincount(far, met[s]) / np.bincount(far)
        trees = next((t for t in range(1, TREES + 1) if ((1 - q) ** t @ np.bincount(far)) <= MISS * len(sample)), None)
        if trees:
            entries = 1 + (min(2, s) if codes.width > 1 else 0)
            best = min(best, (trees * (entries * ENTRY_US + s * codes.width * (2e-4 * d + 6e-3) + chance[s] * n / 2 * PAIR_US), s, trees))
    return best[1:]


class Sketch:
    """Coordinates along the main axes of a sample in a byte each: differences are never greater than those of the directions
    but for the rounding, so no pair within ``reach`` is lost."""

    def __init__(self, sample: np.ndarray, least: float):
        some = sample[: max(64, 2_000_000 // sample.shape[1])]
        axes = np.linalg.svd(some - some.mean(0), full_matrices=False)[2].T
        limit = 2 - 2 * least
        met = lambda x: ((np.square(x).sum(1)[:, None] + np.square(x).sum(1) - 2 * x @ x.T <= limit).sum(1) > 1).mean()
        # as many axes as keep most of those apart that are
        wanted = next((s for s in SKETCH if met(some @ axes[:, :s]) <= met(some) + 0.02), SKETCH[-1])
        self.axes = axes[:, :wanted].copy()
        at = sample @ self.axes
        self.low = at.min(0)
        self.step = np.maximum((at.max(0) - self.low) / 255, 1e-7).astype(np.float32)
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * (least - 1e-5))) + np.linalg.norm(self.step) + 1e-4)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x @ self.axes - self.low) / self.step), 0, 255).astype(np.uint8)


def _partners(code: np.ndarray, at: np.ndarray | None, reach: float) -> np.ndarray:
    """Which entries, in order of their codes, have another of their code within reach; all of more than ``BLOCK`` alike."""
    edge = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0, [True]]))
    sizes = np.diff(edge)
    if at is None:
        return np.repeat(sizes > 1, sizes)
    found = np.repeat(sizes > BLOCK, sizes)
    small, after = np.repeat((sizes > 1) & (sizes <= 24), sizes), np.repeat(edge[1:], sizes) - np.arange(len(code))
    i = np.flatnonzero(small)
    for off in range(1, 24):
        i = i[after[i] > off]
        if not len(i):
            break
        gap = at[i] - at[i + off]
        hit = i[np.einsum("ij,ij->i", gap, gap) <= reach * reach]
        found[hit] = found[hit + off] = True
    square = np.einsum("ij,ij->i", at, at)
    for r in np.flatnonzero((sizes > 24) & (sizes <= BLOCK)):
        a, b = edge[r], edge[r + 1]
        step = max(16, CELLS // (b - a))
        for first in range(a, b, step):
            last = min(b, first + step)
            near = square[first:last, None] + square[a:b] - 2 * (at[first:last] @ at[a:b].T) <= reach * reach + 1e-4
            near[np.arange(last - first), np.arange(first - a, last - a)] = False
            found[first:last] |= near.any(1)
    return found


def alike(vectors: DataFrame, size: int, least: float, k: int = 5, seed: int = 7) -> DataFrame:
    """(obs_a, obs_b), a < b, of at least that similarity and each among the other's k most similar.

    Whatever is less similar can't be part of a pair, so neighbours beyond ``least`` aren't searched: vectors meet where they share
    a code (see ``Codes``); of those only the ones with a partner within reach (see ``Sketch``) are compared exactly. Copies beyond the
    k + 1 smallest names are in nobody's k most similar."""
    active = _copies(cut(vectors), k)[1]
    spark, n = active.sparkSession, active.count()
    nothing = spark.createDataFrame([], "obs_a string, obs_b string")
    if n < 2:
        return nothing
    wanted = int(min(2048, max(256, 4_000_000 // min(size, DIMENSIONS))))
    sample = [r["v"] for r in active.filter(F.pmod(F.xxhash64("k"), F.lit(n)) < wanted).select("v").limit(4 * wanted).collect()]
    drawn = unit(folded(pd.Series(sample if len(sample) > 1 else [r["v"] for r in active.select("v").limit(wanted).collect()]), size))
    symbols, trees = fitting(drawn, n, least, seed)
    codes = Codes(drawn.mean(0), symbols, trees, seed)
    # variables that share dimensions by hashing can be further apart there than they are
    sketch = Sketch(drawn, least) if size <= DIMENSIONS else None
    per = trees * codes.probes
    entry = np.dtype([("p", "<i8"), ("id", "<i8"), ("s", "u1", (sketch.axes.shape[1] if sketch else 0,))])
    tasks = int(max(4 * partitions(spark), n * per // HELD))
    common, m = np.unique(codes(drawn), return_counts=True)
    common = common[(m >= 8) & (m * n / len(drawn) > max(BLOCK, n / 256))]  # of so many vectors that they are compared in blocks anyway

    def sign(batches):
        # entries travel packed, a row for each task in place of one for each entry
        step = max(64, CHUNK // per)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = unit(folded(pd.Series(part.column("v").to_pylist()), size))
                e = np.empty((len(x), per), entry)
                e["p"], e["id"] = codes(x), part.column("id").to_numpy()[:, None]
                if sketch:
                    e["s"] = sketch(x)[:, None]
                e = e.ravel()
                task = ((e["p"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % tasks
                often = np.isin(e["p"], common)
                task[often] = tasks + (e["id"][often] & 0x7FFFFFFF) % tasks
                order = np.argsort(task, kind="stable")
                e, ends = e[order], np.cumsum(np.bincount(task, minlength=2 * tasks))
                to = np.flatnonzero(np.diff(ends, prepend=0))
                yield pa.RecordBatch.from_arrays([pa.array(to % tasks, pa.int32()), pa.array(to >= tasks), pa.array([e[a:z].tobytes() for a, z in zip(np.concatenate([[0], ends])[to], ends[to])], pa.binary())], names=["task", "often", "e"])

    def partners(t: pa.Table) -> pa.Table:
        read = lambda rows: np.frombuffer(b"".join(rows.column("e").to_pylist()), entry)
        whole, e = read(t.filter(t.column("often"))), read(t.filter(pc.invert(t.column("often"))))
        e = e[np.argsort(e["p"], kind="stable")]
        code, found, at = e["p"].copy(), np.zeros(len(e), bool), 0
        while at < len(e):
            end = min(at + CHUNK, len(e))
            if end < len(e):
                end = int(np.searchsorted(code, code[end]))
                end = end if end > at else int(np.searchsorted(code, code[at], "right"))
            alone = sketch and (end - at <= BLOCK or code[at] != code[end - 1])
            found[at:end] = _partners(code[at:end], e["s"][at:end] * sketch.step if alone else None, sketch.reach if alone else 0.0)
            at = end
        e = np.concatenate([whole, e[found]])
        return pa.table({"id": e["id"].copy(), "p": e["p"].copy()})

    active = active.withColumn("id", F.xxhash64("k"))
    entries = active.select("v", "id").mapInArrow(sign, "task int, often boolean, e binary").groupBy("task").applyInArrow(partners, "id long, p long")
    entries = cut(entries.select("id", F.lit(0).alias("tree"), F.lit(0).alias("level"), "p", F.lit(True).alias("asks")))
    m = entries.count()
    if not m:
        return nothing
    found = _found(entries, active, size, k, max(partitions(spark), m // (4 * BLOCK)), on="id", even=True)
    return mutual(_lists(found, k, max(partitions(spark), m // ENTRIES), even=True), least)


def mutual(neighbours: DataFrame, least: float) -> DataFrame:
    """(obs_a, obs_b), a < b, of at least that similarity and each among the other's neighbours."""
    near = neighbours.filter(F.col("similarity") >= least)
    pair = near.select(F.least("k", "neighbour").alias("obs_a"), F.greatest("k", "neighbour").alias("obs_b"))
    return pair.groupBy("obs_a", "obs_b").agg(F.count("*").alias("n")).filter("n > 1").select("obs_a", "obs_b")
