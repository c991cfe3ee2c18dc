"""Single molecules: annotation by shifted bins, random placement, and mixtures made in silico."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.nnls import nnls_rows
from lodestone.operators.annotate import annotate, projection_of
from lodestone.operators.elementwise import normalize_total, row_mode
from lodestone.operators.packed import CELLS, ENTRIES, NAMES, Rows
from lodestone.operators.platform import random_platform_effect, rescaling_factors
from lodestone.operators.spatial import bin_points, periodic_distance
from lodestone.operators.split import exact_block, hand_out, split_exact
from lodestone.operators.aggregate import reference_profiles
from lodestone.runtime import cut, partitions

#: Bins along a side of a tile, most molecules of a tile, and molecules of a task.
TILE, MOST, TASK = 32, 4_000_000, 500_000


def annotate_molecules(molecules: DataFrame, reference: DataFrame, labels: DataFrame, bin_size: float, shifts: int = 2, method: str = "nnls", **kw) -> DataFrame:
    """(obs, category) of molecules (obs, x, y, gene): for every shift of the grid, bins become observations, are annotated and split
    exactly, and the split counts are handed out to the molecules; the most frequent label over all shifts counts.

    Where a bin's label follows from the bin and the profiles alone (nnls and projection, no other options), tiles of the plane
    are annotated as a whole, each by one task that holds the molecules of all of its bins."""
    tiled = _in_tiles(molecules, reference, labels, bin_size, shifts, method, kw)
    return _by_shifts(molecules, reference, labels, bin_size, shifts, method, **kw) if tiled is None else tiled


def _in_tiles(molecules: DataFrame, reference: DataFrame, labels: DataFrame, bin_size: float, shifts: int, method: str, kw: dict) -> DataFrame | None:
    """``annotate_molecules`` tile by tile; None where it can't be: other methods and options, variables that ``annotate`` may leave out as
    constant, tiles of more than ``MOST`` molecules."""
    if not (method == "projection" and not kw.keys() - {"metric", "deconvolution"} or method == "nnls" and not kw):
        return None
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = fine("x") & fine("y") & F.col("obs").isNotNull() & F.col("gene").isNotNull()
    low = molecules.filter(whole).agg(F.min("x"), F.min("y")).first()
    if low[0] is None:
        return None
    cell, side, halo = bin_size / shifts, TILE * shifts, shifts - 1
    place = lambda c, m: F.coalesce(F.floor((F.col(c) - m) / cell), F.lit(0)).cast("long").alias(f"s{c}")
    placed = molecules.select("obs", F.when(whole, F.col("gene")).alias("gene"), place("x", low[0]), place("y", low[1]))
    tile = lambda c: F.floor(F.col(f"s{c}") / side).cast("long").alias(f"t{c}")
    count = cut(placed.filter("gene is not null").groupBy(tile("x"), tile("y"), "gene").agg(F.count("*").alias("n")))
    top = count.groupBy("tx", "ty").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).first()
    clean = labels.filter("category is not null").select("obs", "category")
    if top["n"] > MOST or count.select("gene").distinct().count() > NAMES or clean.groupBy("obs").count().filter("count > 1").take(1):
        return None
    # (category, var) of the reference: reads, and the least and the greatest value
    known = cut(reference.select("obs", "var", "value").filter("value > 0").join(clean, "obs", "left").groupBy("category", "var").agg(F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    if known.select("category").distinct().count() * known.select("var").distinct().count() > ENTRIES:
        return None
    known, reads = known.toPandas(), {r[0]: float(r[1]) for r in count.groupBy("gene").agg(F.sum("n")).toLocalIterator()}
    ends = known.groupby("var").agg({"s": "sum", "lo": "min", "hi": "max"})
    common = sorted(set(reads) & set(ends.index))
    if not common or (ends["lo"] >= ends["hi"]).loc[common].any() or not _varied(placed, top, side, shifts, common):
        return None
    sums = known.dropna(subset=["category"]).pivot(index="var", columns="category", values="s").fillna(0.0)
    sums = sums.sort_index().sort_index(axis=1)
    own = sums.reindex(common).fillna(0.0).to_numpy()
    if method == "projection":
        a, b = ends["s"].loc[common].to_numpy()[None], np.array([reads[v] for v in common])[None]
        own = own * rescaling_factors(a / a.sum(), b / b.sum())[:, None]
    in_use, cats = np.flatnonzero((own > 0).any(1)), np.flatnonzero((own > 0).any(0))
    if not len(cats):
        return None
    profile = own[np.ix_(in_use, cats)]
    profile = profile / profile.sum(0)
    solve = projection_of(profile, **kw) if method == "projection" else lambda r, g=profile.T @ profile: nnls_rows(g, r.block @ profile)
    var, cat = list(sums.index), pa.array(list(sums.columns), pa.string())
    m = sums.to_numpy() / sums.to_numpy().sum(0) + 1e-3 / len(var)
    m = m / m.sum(0)
    shared = np.searchsorted(var, common)  # variables of the reference that are measured

    def label(bins: np.ndarray, names: pa.Array, gene: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, category) of every read that is handed out, in order; cells are bins times variables."""
        block = np.bincount(bins * len(var) + gene, minlength=size * len(var)).reshape(size, len(var)).astype(float)
        some = np.flatnonzero(block[:, shared].sum(1) > 0)
        part = block[np.ix_(some, shared)]
        row, at = np.nonzero(part)
        w = np.maximum(0, solve(Rows(names.take(pa.array(some)), part[:, in_use], row, part[row, at], None)))
        s = w.sum(1, keepdims=True)
        share = np.zeros((len(some), len(cat)))
        share[:, cats] = np.divide(w, s, out=np.full_like(w, 1 / len(cats)), where=s > 0)
        i, k, j, n = exact_block(m, block[some], share, names.take(pa.array(some)), None, 0)
        order = np.lexsort([k, j, i])
        n = n[order].astype(np.int64)
        return np.repeat(some[i[order]] * len(var) + j[order], n), np.repeat(k[order], n)

    def vote(sx: np.ndarray, sy: np.ndarray, gene: np.ndarray, own: np.ndarray, a: int, b: int) -> np.ndarray:
        """Categories of molecules in order of variable and name, -1 for none, in the bins of one shift that hold molecules of the tile's own."""
        out = np.full(len(sx), -1)
        bx, by = (sx + a) // shifts, (sy + b) // shifts
        wide = by.max() - by.min() + 1
        key = (bx - bx.min()) * wide + by - by.min()
        mine = np.zeros(key.max() + 1, bool)
        mine[key[own]] = True
        at = np.flatnonzero((gene >= 0) & mine[key])
        there = np.zeros(len(mine), bool)
        there[key[at]] = True
        used, bins = np.flatnonzero(there), (np.cumsum(there) - 1)[key[at]]
        order = np.argsort(bins.astype(np.uint16) if len(used) < 1 << 16 else bins, kind="stable")
        at, bins = at[order], bins[order]
        step = max(16, CELLS // len(var))
        for low in range(0, len(used), step):
            e = slice(*np.searchsorted(bins, [low, low + step]))
            u = used[low : low + step]
            names = pa.array([f"{p}_{q}" for p, q in zip(u // wide + bx.min(), u % wide + by.min())], pa.string())
            to, k = label(bins[e] - low, names, gene[at[e]], len(u))
            cells = (bins[e] - low) * len(var) + gene[at[e]]
            begin = np.flatnonzero(np.diff(cells, prepend=-1))
            n = np.diff(begin, append=len(cells))
            first = np.repeat(np.searchsorted(to, cells[begin]) - begin, n) + np.arange(len(cells))
            ok = first < np.repeat(np.searchsorted(to, cells[begin], "right"), n)
            out[at[e][ok]] = k[first[ok]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        obs = t.column("obs").combine_chunks()
        tx, ty, sx, sy, gene = (t.column(c).to_numpy() for c in ("tx", "ty", "sx", "sy", "g"))
        order = np.lexsort([ty, tx])
        new = np.flatnonzero((np.diff(tx[order]) != 0) | (np.diff(ty[order]) != 0)) + 1
        for part in np.split(order, new):
            names = obs.take(pa.array(part))
            sort = pc.sort_indices(names).to_numpy()
            sort = sort[np.argsort(gene[part[sort]], kind="stable")]
            names, part = names.take(pa.array(sort)), part[sort]
            x, y, g = sx[part], sy[part], gene[part]
            own = (x // side == tx[part]) & (y // side == ty[part])
            if not own.any():
                continue
            votes = np.stack([vote(x, y, g, own, a, b)[own] for a in range(shifts) for b in range(shifts)], 1)
            score = np.stack([(votes == votes[:, [c]]).sum(1) * (len(cat) + 1) - votes[:, c] - (votes[:, c] < 0) * (votes.shape[1] + 1) * (len(cat) + 1) for c in range(votes.shape[1])], 1)
            best = votes[np.arange(len(votes)), score.argmax(1)]
            yield pa.RecordBatch.from_arrays([names.filter(pa.array(own)), cat.take(pa.array(best, mask=best < 0))], names=["obs", "category"])

    spark = molecules.sparkSession
    table = F.broadcast(spark.createDataFrame(pd.DataFrame({"gene": pd.Series(var, dtype=object), "g": np.arange(len(var), dtype=np.int32)}), "gene string, g int")) if len(var) <= NAMES else None
    if table is None:
        return None
    near = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"s{c}") + d) / side).cast("long") for d in (-halo, halo)])))
    rows = placed.join(table, "gene", "left").select("obs", "sx", "sy", F.coalesce("g", F.lit(-1)).alias("g")).withColumn("tx", near("x")).withColumn("ty", near("y"))
    tasks = max(partitions(spark), int(sum(reads.values()) // TASK) + 1)
    return rows.repartition(tasks, "tx", "ty").mapInArrow(run, f"obs {molecules.schema['obs'].dataType.simpleString()}, category string")


def _varied(placed: DataFrame, tile, side: int, shifts: int, names: list[str]) -> bool:
    """Whether, for every shift, each variable has unequal counts in two bins within the tile: then none is constant over all bins."""
    inside = placed.filter((F.floor(F.col("sx") / side) == tile["tx"]) & (F.floor(F.col("sy") / side) == tile["ty"]) & F.col("gene").isNotNull())
    n = inside.groupBy("sx", "sy", "gene").agg(F.count("*").alias("n")).toPandas()  # at most MOST
    for a in range(shifts):
        for b in range(shifts):
            bins = n.assign(bx=(n["sx"] + a) // shifts, by=(n["sy"] + b) // shifts)
            for c, k, t in (("bx", a, "tx"), ("by", b, "ty")):
                first = bins[c] * shifts - k
                bins = bins[(first >= tile[t] * side) & (first + shifts <= (tile[t] + 1) * side)]
            sums = bins.groupby(["bx", "by", "gene"])["n"].sum().unstack(fill_value=0).reindex(columns=names, fill_value=0)
            # what only other bins hold is not constant if a bin here holds none of it
            if len(sums) < 1 or not ((sums.min() < sums.max()) | (sums.max() == 0)).all():
                return False
    return True


def _by_shifts(molecules: DataFrame, reference: DataFrame, labels: DataFrame, bin_size: float, shifts: int, method: str, **kw) -> DataFrame:
    """``annotate_molecules`` shift by shift, each over the whole plane."""
    names, parts = [], []
    profiles = reference_profiles(reference, labels)
    for a in range(shifts):
        for b in range(shifts):
            s = cut(bin_points(bin_points(molecules, bin_size, ["x"], ["bx"], -bin_size * a / shifts), bin_size, ["y"], ["by"], -bin_size * b / shifts).withColumn("bin", F.concat_ws("_", "bx", "by")))
            counts = s.groupBy(F.col("bin").alias("obs"), F.col("gene").alias("var")).agg(F.count("*").cast("double").alias("value"))
            w = annotate(counts, reference, labels, method, **kw)
            split = split_exact(counts, w, profiles, seed=0)
            n = split.select(F.concat_ws("\u0001", "obs", "var").alias("cell"), "category", F.col("value").cast("long").alias("n"))
            got = hand_out(s.select("obs", F.concat_ws("\u0001", "bin", "gene").alias("cell")), n, "cell", "obs")
            names.append(f"l{a}{b}")
            parts.append(got.select("obs", F.col("category").alias(names[-1])))
    wide = reduce(lambda p, q: p.join(q, "obs"), parts)
    return row_mode(wide, "obs", names).withColumnRenamed("mode", "category")


def distribute_molecules(x: DataFrame, positions: DataFrame, width: float, seed: int = 0) -> DataFrame:
    """(obs, gene, x, y): one row for each count, around the observation's position with a normal spread."""
    rows = x.filter("value >= 1").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("value").cast("int")))).join(positions, "obs")
    return rows.select("obs", F.col("var").alias("gene"), (F.col("x") + width * F.randn(seed)).alias("x"), (F.col("y") + width * F.randn(seed + 1)).alias("y"))


def named_molecules(x: DataFrame, positions: DataFrame, width: float, seed: int = 0) -> DataFrame:
    """As ``distribute_molecules``, named obs|gene|k, with places drawn by hashes of the names: reading it again gives the same."""
    u = lambda k: (F.pmod(F.xxhash64("obs", "var", "_k", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    rows = x.filter("value >= 1").join(positions, "obs").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("value").cast("int"))))
    rows = rows.withColumn("_r", width * F.sqrt(-2 * F.log(u(1)))).withColumn("_a", 2 * np.pi * u(2))
    return rows.select(F.concat_ws("|", "obs", "var", F.col("_k").cast("string")).alias("obs"), F.col("var").alias("gene"), (F.col("x") + F.col("_r") * F.cos("_a")).alias("x"), (F.col("y") + F.col("_r") * F.sin("_a")).alias("y"))


#: Weights below this count as 0.
LEAST = 1e-3
_SOFT = 1.16


def bead_profile(shape: str | float, scale: float) -> tuple[Callable, Callable, float]:
    """(profile of a distance column, the same of numbers, integral over the plane): 'gauss', 'disc', or the softness of a disc whose
    edge falls like a hyperbolic tangent; 1 at distance 0."""
    if shape == "gauss":
        return (lambda d: F.exp(-0.5 * (d / scale) ** 2)), (lambda d: np.exp(-0.5 * (d / scale) ** 2)), 2 * np.pi * scale**2
    if shape == "disc":
        return (lambda d: (d < scale).cast("double")), (lambda d: (d < scale) * 1.0), np.pi * scale**2
    width = _SOFT * float(shape) * scale
    edge = lambda d: (np.tanh(-(d - scale) / width) + 1) / 2
    r = np.linspace(0, 5 * (scale + width), 20_001)
    area = float(np.trapezoid(2 * np.pi * r * edge(r), r)) / edge(0.0)
    return (lambda d: (F.tanh(-(d - scale) / width) + 1) / 2 / float(edge(0.0))), (lambda d: edge(d) / edge(0.0)), area


def mix_in_silico(
    x: DataFrame,
    labels: DataFrame,
    beads: int | None = 30_000,
    bead_size: float = 1.0,
    shape: str | float = 0.1,
    capture_rate: float | str | None = 1.0,
    norm_cells: bool = False,
    platform_log10_mean: float | None = None,
    platform_log10_std: float = 0.6,
    round: bool = True,
    min_counts: float | None = 100,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(counts, labels) of beads at random places on the unit torus that collect the reads of observations at random places.

    A bead of size 1 is as wide as an observation if they fill the plane. Weights follow ``shape`` (see ``bead_profile``), times
    ``capture_rate``; divided by their sum over the bead's observations ('normalized'), or by the integral of the profile
    times the number of observations (None). ``norm_cells`` scales observations to their median total; with a
    ``platform_log10_mean`` variables get random factors. Beads below ``min_counts`` drop out. The labels (obs, category, weight,
    mass, reads, bare_reads) are the share of reads, the sum of weights, and the reads with and without the factors.
    Candidate pairs come from grid cells as wide as the weights reach, not from all pairs."""
    spark = x.sparkSession
    beads = 30_000 if beads is None else beads
    labels = cut(labels.filter("category is not null").select("obs", "category"))
    n_obs = max(1, labels.count())
    scale = bead_size * 0.5 / n_obs**0.5
    column, number, area = bead_profile(shape, scale)
    factor = float(capture_rate) if isinstance(capture_rate, (int, float)) else 1.0 if capture_rate == "normalized" else 1 / (n_obs * area)
    floor = LEAST * 1e-3 if capture_rate == "normalized" else LEAST
    far = np.linspace(0, 12 * scale * (1 + (0 if isinstance(shape, str) else float(shape))), 24_001)
    inside = far[number(far) * factor >= floor]
    reach = min(0.5, float(inside.max(initial=0.0)) + far[1])
    u = lambda c, k: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)
    n = max(1, int(1 / max(reach, 1e-6)))
    cell = lambda c: F.least(F.lit(n - 1), F.floor(F.col(c) * n)).cast("int")
    obs = labels.withColumn("x", u("obs", 1)).withColumn("y", u("obs", 2)).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    bead = spark.range(beads).select(F.format_string("bead%d", "id").alias("bead")).withColumn("bx", u("bead", 3)).withColumn("by", u("bead", 4)).withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    bead = bead.select("bead", "bx", "by", F.pmod(cell("bx") + F.col("c.i"), F.lit(n)).alias("cx"), F.pmod(cell("by") + F.col("c.j"), F.lit(n)).alias("cy")).distinct()
    d = periodic_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    pairs = obs.join(bead, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= reach).withColumn("w", column(F.col("d")) * factor)
    if capture_rate == "normalized":
        pairs = pairs.withColumn("w", F.try_divide("w", F.sum("w").over(Window.partitionBy("bead"))))
    pairs = cut(pairs.filter(F.col("w") >= LEAST).select("obs", "bead", "category", "w"))
    bare = x.select("obs", "var", "value")
    bare = normalize_total(bare) if norm_cells else bare
    scaled = bare if platform_log10_mean is None else random_platform_effect(bare, platform_log10_mean, platform_log10_std, seed)[0]
    value = F.sum(F.col("value") * F.col("w"))
    counts = scaled.join(pairs, "obs").groupBy(F.col("bead").alias("obs"), "var").agg((F.bround(value, 0) if round else value).alias("value")).filter("value <> 0")
    if min_counts is not None:
        counts = cut(counts)
        enough = counts.groupBy("obs").agg(F.sum("value").alias("n")).filter(F.col("n") >= min_counts).select("obs")
        counts, pairs = counts.join(enough, "obs", "left_semi"), pairs.join(enough.withColumnRenamed("obs", "bead"), "bead", "left_semi")
    total = lambda m, name: m.groupBy("obs").agg(F.sum("value").alias(name))
    reads = pairs.join(total(scaled, "t"), "obs").join(total(bare, "b"), "obs")
    soft = reads.groupBy(F.col("bead").alias("obs"), "category").agg(F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("t")).alias("reads"), F.sum(F.col("w") * F.col("b")).alias("bare_reads"))
    return counts, soft.select("obs", "category", F.try_divide("reads", F.sum("reads").over(Window.partitionBy("obs"))).alias("weight"), "mass", "reads", "bare_reads")
