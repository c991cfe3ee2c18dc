"""Transfer of category labels from a reference to observations, as soft labels that sum to 1.

A method is a function ``(counts, profiles, priors) -> (obs, category, weight)``: counts(obs, var, value) of the data,
profiles(var, category, p) of the reference, priors(category, prior). Methods run on packed rows in Arrow batches, with the
profiles (variables by categories, of checked size) sent along; wrappers compose methods.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.nnls import nnls_rows
from lodestone.functions.transport import kmeans, minimal_transitions, nmf
from lodestone.operators import elementwise as E
from lodestone.operators import qc
from lodestone.operators.aggregate import category_priors, reference_profiles
from lodestone.operators.packed import Rows, axes, dense, kind, long, packed, per_block, small, summed
from lodestone.operators.similarity import distance_kernel, freed, overlap_kernel
from lodestone.runtime import cut

WEIGHTS = ("obs", "category", "weight")
#: Longest Newton step of a scaling's logarithm.
LONGEST = 3.0
Method = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def profile_matrix(profiles: DataFrame) -> tuple[np.ndarray, list[str], list[str]]:
    """(variables by categories, variables, categories)."""
    return small(profiles, "var", "category", "p", "profiles")


def per_row(x: DataFrame, var: list[str], cat: list[str], solve: Callable[[Rows], np.ndarray]) -> DataFrame:
    """``solve`` maps rows to weights (observations by ``cat``); rows that get no weight have equal ones."""

    def run(r: Rows) -> pa.RecordBatch:
        w = np.maximum(0, solve(r))
        s = w.sum(1, keepdims=True)
        w = np.divide(w, s, out=np.full_like(w, 1 / w.shape[1]), where=s > 0)
        return long(r.names, cat, w, (w > 0).ravel(), WEIGHTS)

    return per_block(packed(x, var), len(var), run, f"obs {kind(x)}, category string, weight double")


def annotate_nnls(x: DataFrame, profiles: DataFrame, priors: DataFrame) -> DataFrame:
    m, var, cat = profile_matrix(profiles)
    gram = m.T @ m
    return per_row(x, var, cat, lambda r: nnls_rows(gram, r.block @ m))


def annotate_projection(x: DataFrame, profiles: DataFrame, priors: DataFrame, metric: str = "bc2", deconvolution: str | bool | None = None) -> DataFrame:
    """Overlaps with the profiles, freed of the profiles' overlaps among each other ('linear' for bc, else 'nnls'; False: not)."""
    m, var, cat = profile_matrix(profiles)
    return per_row(x, var, cat, projection_of(m, metric, deconvolution))


def projection_of(m: np.ndarray, metric: str = "bc2", deconvolution: str | bool | None = None) -> Callable[[Rows], np.ndarray]:
    """``annotate_projection`` as a function of dense rows over the variables of profiles ``m``."""
    how = ("linear" if metric == "bc" else "nnls") if deconvolution is None else deconvolution
    kernel = overlap_kernel(m, metric)
    solve = freed(kernel(_matrix_rows(m.T))[0], how) if how else lambda v: v

    def run(r: Rows) -> np.ndarray:
        w = solve(kernel(r)[0])
        return np.maximum(0, w) ** 2 if metric == "bc" else w

    return run


def _matrix_rows(m: np.ndarray) -> Rows:
    row, _ = np.nonzero(m)
    return Rows(pa.array([str(k) for k in range(len(m))]), m, row, m[m != 0], None)


def _relaxed(lamb: float | None, epsilon: float) -> float:
    return 1.0 if lamb is None else lamb / (lamb + epsilon)


@dataclass
class Transport:
    """Entropic transport between many rows and few columns, whose rows are never gathered.

    ``rows`` holds (obs, d, a): the costs to the columns and the weight of each row; ``b`` are the columns' weights. A side with a
    lambda is relaxed. The plan is exp(u + v - cost / epsilon); an iteration is one pass that returns, from each task, a sum
    and its derivative for each column, so that Newton steps, where they help, take the place of most plain ones. It ends
    when the columns' scalings v move by less than 1e-9, with a warning if ``rounds`` passes don't get there."""

    rows: DataFrame
    b: np.ndarray
    epsilon: float
    lambda_a: float | None = None
    lambda_b: float | None = None
    rounds: int = 1000
    v: np.ndarray = field(init=False)

    def kernel(self, epsilon: float) -> Callable:
        fa, n = _relaxed(self.lambda_a, epsilon), len(self.b)

        def run(batch: pa.RecordBatch, v: np.ndarray):
            k = -batch.column("d").flatten().to_numpy().reshape(-1, n) / epsilon + v
            m = k.max(1, keepdims=True)
            e = np.exp(k - m)
            s = e.sum(1)
            u = fa * (np.log(batch.column("a").to_numpy()) - (np.log(s) + m[:, 0]))
            return k, e / s[:, None], u

        return run

    def solve(self) -> Transport:
        # a sharp problem with (nearly) fixed sides starts from blunter ones
        steps = [self.epsilon]
        while steps[-1] < 0.05 and _relaxed(self.lambda_a, self.epsilon) * _relaxed(self.lambda_b, self.epsilon) > 0.99:
            steps.append(4 * steps[-1])
        v, left = np.zeros(len(self.b)), self.rounds
        for before, epsilon in zip([None, *steps[::-1]], steps[::-1]):
            v = v if before is None else v * (before / epsilon)
            v, used, move = self._solve(v, epsilon, 1e-9 if epsilon == self.epsilon else 1e-2, left)
            left -= used
        if move >= 1e-9:
            warnings.warn(f"transport: the scalings still moved by {move:.2g} after {self.rounds} rounds", stacklevel=3)
        self.v = v
        return self

    def _solve(self, v: np.ndarray, epsilon: float, stop: float, rounds: int) -> tuple[np.ndarray, int, float]:
        n, fa, fb, kernel = len(self.b), _relaxed(self.lambda_a, epsilon), _relaxed(self.lambda_b, epsilon), self.kernel(epsilon)
        before, plain, move, used = np.inf, None, np.inf, 0
        while used < rounds:
            used += 1

            def columns(batches: Iterator[pa.RecordBatch], v=v) -> Iterator[pa.RecordBatch]:
                top, s, g = np.full(n, -np.inf), np.zeros(n), np.zeros((n, n))
                for batch in batches:
                    for at in range(0, batch.num_rows, max(1, 2_000_000 // n)):
                        k, own, u = kernel(batch.slice(at, max(1, 2_000_000 // n)), v)
                        z = u[:, None] + k - v
                        m = np.maximum(top, z.max(0))
                        old = np.where(np.isfinite(top), np.exp(top - m), 0.0)
                        q = np.exp(z - m)
                        top, s, g = m, s * old + q.sum(0), g * old[:, None] + q.T @ own
                if s.any():
                    yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (top, s, g)], names=["m", "s", "g"])

            parts = self.rows.mapInArrow(columns, "m binary, s binary, g binary").collect()  # a row a task, columns by columns
            if not parts:
                return v, used, 0.0
            ms, ss, gs = (np.stack([np.frombuffer(r[c]) for r in parts]) for c in "msg")
            m = ms.max(0)
            share = np.exp(ms - m)
            s = (ss * share).sum(0)
            new = fb * (np.log(np.maximum(self.b, 1e-300)) - (np.log(s) + m))
            if fa * fb == 1:  # the scalings of fixed sides are free up to a constant
                v, new = v - v.mean(), new - new.mean()
            move = np.abs(new - v).max()
            if move < stop:
                return new, used, move
            if plain is not None and not move <= before:  # the Newton step led away: back to the plain one
                v, plain = plain, None
                continue
            slope = fa * fb * (gs.reshape(len(parts), n, n) * share[:, :, None]).sum(0) / s[:, None]
            before, plain = move, new
            step = np.linalg.lstsq(np.eye(n) - slope + (1.0 / n if fa * fb == 1 else 0.0), new - v, rcond=None)[0]
            v = v + step * min(1.0, LONGEST / max(np.abs(step).max(), 1e-300))
        return v, used, move

    def plan(self) -> Callable[[pa.RecordBatch], np.ndarray]:
        """Gives the plan's rows, each divided by its sum."""
        kernel, v = self.kernel(self.epsilon), self.v
        return lambda batch: kernel(batch, v)[1]


def _costs(x: DataFrame, var: list[str], kernel: Callable[[Rows], np.ndarray]) -> tuple[DataFrame, float]:
    """((obs, d, a), top): costs of packed rows, each with its reads, and the greatest cost."""

    def run(r: Rows) -> pa.RecordBatch:
        d = kernel(r)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32)), pa.array(d.ravel()))
        return pa.RecordBatch.from_arrays([r.names, lists, pa.array(r.sums())], names=["obs", "d", "a"])

    rows = cut(per_block(packed(x, var), len(var), run, f"obs {kind(x)}, d array<double>, a double"))
    return rows, rows.agg(F.max(F.array_max("d"))).first()[0] or 1.0


def annotate_ot(x: DataFrame, profiles: DataFrame, priors: DataFrame, epsilon: float = 5e-3, lamb: float | None = 0.1, metric: str = "h2", rounds: int = 1000, decomposition: bool = False) -> DataFrame:
    """Semi-unbalanced entropic transport between observations (weighted by reads) and categories (by priors).

    ``decomposition`` removes the confusion of the categories among each other: even mixtures of pairs of profiles are measured
    by the same transport, and the mass that minimally moves from a mixture's categories to what was measured gives the
    measurement of each category, from which the observations are composed by non-negative least squares."""
    m, var, cat = profile_matrix(profiles)
    kernel = distance_kernel(m, metric)
    rows, top = _costs(x, var, kernel)
    prior = {r["category"]: r["prior"] for r in priors.collect()}  # a row a category
    b = np.array([prior.get(c) or 0.0 for c in cat])
    b = b / b.sum()
    total = rows.agg(F.sum("a")).first()[0] or 1.0
    scaled = cut(rows.select("obs", F.transform("d", lambda c: c / top).alias("d"), (F.col("a") / total).alias("a")))
    ot = Transport(scaled, b, epsilon, None, lamb, rounds).solve()
    plan, solve = ot.plan(), lambda w: w
    if decomposition:
        pairs = [(i, j) for i in range(len(cat)) for j in range(i, len(cat))]
        mix = np.array([[(i == k) / 2 + (j == k) / 2 for k in range(len(cat))] for i, j in pairs])
        d = kernel(_matrix_rows(mix @ (m / m.sum(0)).T))
        probe = pa.RecordBatch.from_arrays([pa.array(list(d / top), pa.list_(pa.float64())), pa.array(np.full(len(d), 1e-6 / len(d)))], names=["d", "a"])
        measured = plan(probe)
        given = mix / mix.sum(0)
        # measurement x annotation: the mass moved from each annotation of a mixture to each measurement, over all mixtures
        moved = [minimal_transitions(a, q) / np.where(a > 0, a, 1)[:, None] for a, q in zip(mix, measured)]
        confusion = sum(given[k][:, None] * moved[k] for k in range(len(pairs)))
        solve = freed(confusion, "nnls")
    shape = f"obs {kind(x)}, category string, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = solve(plan(batch))
                w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
                yield long(batch.column("obs"), cat, w, (w > 1e-12).ravel(), WEIGHTS)

    return scaled.mapInArrow(run, shape)


def sample(reference: DataFrame, labels: DataFrame, bound: int, seed: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(block, variables, labels) of at most ``bound`` labelled observations, for fitting classifiers."""
    ids = cut(labels.filter("category is not null").orderBy(F.xxhash64("obs", F.lit(seed)), "obs").limit(bound))
    rows = reference.join(ids.select("obs"), "obs", "left_semi")
    var = sorted(r[0] for r in rows.select("var").distinct().collect())
    got = packed(rows, var).join(ids.select("obs", "category"), "obs").select("obs", "category", "s").toArrow()
    parts = [(r.block, r.batch.column("category").to_pylist()) for r in dense(got.to_batches(), len(var))]
    return np.concatenate([p[0] for p in parts]), var, np.array([c for p in parts for c in p[1]], dtype=object)


def annotate_svm(x: DataFrame, reference: DataFrame, labels: DataFrame, mode: str = "classification", trafo: str | None = "sqrt", steps: int = 300, bound: int = 20_000, seed: int = 0) -> DataFrame:
    """Linear one-against-all machines fitted on at most ``bound`` labelled reference observations (the documented sample)."""
    block, var, known = sample(reference, labels, bound, seed)
    cat = sorted(set(known))
    change = {"sqrt": np.sqrt, "log1p": np.log1p, None: lambda z: z}[trafo]

    def prepare(b: np.ndarray) -> np.ndarray:
        q = change(b)
        return np.hstack([q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12), np.ones((len(q), 1))])

    z = prepare(block)
    y = np.where(known[:, None] == np.array(cat, dtype=object), 1.0, -1.0)
    w, lr = np.zeros((z.shape[1], len(cat))), 4.0
    for k in range(steps):  # hinge loss for classes, squared error for shares
        s = z @ w
        g = -(z.T @ (y * (y * s < 1))) / len(z) if mode == "classification" else z.T @ (s - (y + 1) / 2) / len(z)
        w -= lr / (1 + k / 50) * (g + 1e-4 * w)

    def solve(r: Rows) -> np.ndarray:
        s = prepare(r.block) @ w
        return np.eye(len(cat))[s.argmax(1)] if mode == "classification" else np.maximum(0, s)

    return per_row(x, var, cat, solve)


def annotate_nmf(x: DataFrame, reference: DataFrame, labels: DataFrame, k: int = 30, bound: int = 20_000, seed: int = 0) -> DataFrame:
    """Factors of at most ``bound`` labelled reference observations (the documented sample); each factor belongs to the category
    in which it is most often the strongest; observations are fitted to the factors and their loads summed by category."""
    block, var, known = sample(reference, labels, bound, seed)
    cat = sorted(set(known))
    sd = np.maximum(block.std(0), 1e-9)
    share = lambda b: b / np.maximum(b.sum(1, keepdims=True), 1e-12) / sd * sd.mean()
    w, h = nmf(share(block), min(k, *block.shape), seed=seed)
    size = np.maximum(h.sum(1), 1e-12)  # loads of factors are comparable when these are
    w, h = w * size, h / size[:, None]
    strongest = (w / np.maximum(w.max(0), 1e-12)).argmax(1)
    own = np.zeros((h.shape[0], len(cat)))
    for f in range(h.shape[0]):
        names = pd.Series(known[strongest == f])
        if len(names):
            own[f, cat.index(names.mode().iloc[0])] = 1
    gram = h @ h.T
    return per_row(x, var, cat, lambda r: np.sqrt(nnls_rows(gram, share(r.block) @ h.T) ** 2 @ own))


def bisect(method: Method, rounds: int, divisor: int = 3) -> Method:
    """Annotates repeatedly: ``rounds - 1`` times a share 1/divisor of what is left is explained and subtracted, then what is left
    in ``divisor`` equal parts."""
    if divisor < 2:
        raise ValueError("bisection divisor < 2")

    def run(x, profiles, priors):
        rest = x.select("obs", "var", "value")
        shares = [1 / divisor * (1 - 1 / divisor) ** k for k in range(rounds - 1)]
        shares += [(1 - sum(shares)) / divisor] * divisor
        total = x.groupBy("obs").agg(F.sum("value").alias("n"))
        m, var, cat = profile_matrix(profiles)
        parts, left = [], 1.0
        for k, share in enumerate(shares):
            w = cut(method(rest, profiles, priors))
            parts.append(w.select("obs", "category", (F.col("weight") * share).alias("weight")))
            left -= share
            if k < len(shares) - 1:
                rest = _less(rest, w, total, m, var, cat, share, left)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return E.normalize_result(out.groupBy("obs", "category").agg(F.sum("weight").alias("weight")))

    return run


def _less(rest: DataFrame, w: DataFrame, total: DataFrame, m: np.ndarray, var: list[str], cat: list[str], share: float, left: float) -> DataFrame:
    """What is left of each observation's reads: less those that the annotation explains, at entries of the data only, scaled to
    ``left`` of the observation's reads."""
    place = {c: i for i, c in enumerate(cat)}
    soft = w.groupBy("obs").agg(F.collect_list("category").alias("c"), F.collect_list("weight").alias("w"))
    rows = packed(rest, var).join(soft, "obs").join(total, "obs")

    def run(r: Rows) -> pa.RecordBatch:
        c, n = r.batch.column("c"), r.batch.column("n").to_numpy()
        size = c.value_lengths().to_numpy()
        names = pc.index_in(c.flatten(), pa.array(cat, pa.string()))
        weights = np.zeros((len(n), len(place)))
        weights[np.repeat(np.arange(len(n)), size), names.to_numpy()] = r.batch.column("w").flatten().to_numpy()
        value = np.where(r.block > 0, np.maximum(0, r.block - share * n[:, None] * (weights @ m.T)), 0)
        s = value.sum(1, keepdims=True)
        value = np.divide(value, s, out=np.zeros_like(value), where=s > 0) * n[:, None] * left
        return long(r.names, var, value, (value > 0).ravel(), ("obs", "var", "value"))

    return cut(per_block(rows, len(var), run, f"obs {kind(rest)}, var string, value double"))


def keep_max(method: Method, n: int = 1) -> Method:
    return lambda x, profiles, priors: E.max_annotation(method(x, profiles, priors), n)


def multi_center(labels: DataFrame, reference: DataFrame, centers: int, amplitudes: bool = True, components: int = 10, seeds: int = 5_000, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(obs, category, sub): each category's reference observations in at most ``centers`` groups by k-means on the first principal
    components, of all observations, of the square roots of shares (``amplitudes``) or of scaled logarithms.

    The centres start from a k-means of at most ``seeds`` observations of a category; passes over all of them then move the
    centres and assign every observation, until nothing moves or ``rounds`` is reached."""
    labels = labels.filter("category is not null").select("obs", "category")
    var = sorted(r[0] for r in reference.select("var").distinct().collect())
    rows = cut(packed(reference, var).join(labels, "obs"))
    size = len(var)
    if amplitudes:
        change = lambda r: np.sqrt(r.block / np.maximum(r.sums()[:, None], 1e-30))
        ax, _, mean = axes(rows, size, min(components, max(1, size - 1)), change)
    else:
        logs = lambda r: np.log1p(r.block / np.maximum(r.sums()[:, None], 1e-30) * 1e4)
        s = summed(rows, size, lambda r: (lambda b: np.stack([b.sum(0), (b * b).sum(0), np.full(size, float(len(b)))], 1))(logs(r)), size, 3)
        n = np.maximum(s[:, 2], 1)
        mu, sd = s[:, 0] / n, np.sqrt(np.maximum((s[:, 1] - s[:, 0] ** 2 / n) / np.maximum(n - 1, 1), 1e-12))
        change = lambda r: (logs(r) - mu) / sd
        ax, _, mean = axes(rows, size, min(components, max(1, size - 1)), change)

    def place(r: Rows) -> pa.RecordBatch:
        z = (change(r) - mean) @ ax
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
        return pa.RecordBatch.from_arrays([r.names, r.batch.column("category"), lists], names=["obs", "category", "z"])

    points = cut(per_block(rows, size, place, f"obs {kind(reference)}, category string, z array<double>"))
    # seeds: the first of each of many parts by a hash, then the first of those
    part = F.pmod(F.xxhash64("obs", F.lit(seed + 1)), F.lit(64))
    order = [F.xxhash64("obs", F.lit(seed)), F.col("obs")]
    some = points.withColumn("r", F.row_number().over(Window.partitionBy("category", part).orderBy(*order))).filter(F.col("r") <= max(1, seeds // 64) + 1).drop("r")

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf.sort_values("obs")["z"].to_numpy())
        label = kmeans(z, centers, seed=seed)
        return pd.DataFrame({"category": pdf["category"].iloc[0], "z": [z[label == j].mean(0) for j in np.unique(label)]})

    start = some.groupBy("category").applyInPandas(begin, "category string, z array<double>").collect()  # centers a category
    middle: dict[str, np.ndarray] = {}
    for r in start:
        middle.setdefault(r["category"], []).append(r["z"])
    middle = {c: np.array(z) for c, z in middle.items()}

    def nearest(batch: pa.RecordBatch, middle) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        z = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
        category = batch.column("category").to_numpy(zero_copy_only=False)
        for c in np.unique(category):
            at = np.flatnonzero(category == c)
            m = middle[c]
            yield c, at, z[at], ((m * m).sum(1) - 2 * z[at] @ m.T).argmin(1)

    for _ in range(rounds):

        def move(batches: Iterator[pa.RecordBatch], middle=middle) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for c, _, z, to in nearest(batch, middle):
                    for j in np.unique(to):
                        s = np.concatenate([[(to == j).sum()], z[to == j].sum(0)])
                        sums[c, int(j)] = sums.get((c, int(j)), 0) + s
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], names=["category", "j", "s"])

        step = points.mapInArrow(move, "category string, j int, s array<double>").groupBy("category", "j").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(ax.shape[1] + 1)])
        new = {c: m.copy() for c, m in middle.items()}
        for r in step.collect():  # a row a centre
            new[r["category"]][r["j"]] = np.array(r[3:]) / r[2]
        moved = max((np.abs(new[c] - middle[c]).max() for c in new), default=0.0)
        middle = new
        if moved < 1e-9:
            break

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sub = np.empty(batch.num_rows, dtype=object)
            for c, at, _, to in nearest(batch, middle):
                sub[at] = np.array([f"{c}-{j}" for j in range(len(middle[c]))], dtype=object)[to]
            yield pa.RecordBatch.from_arrays([batch.column("obs"), batch.column("category"), pa.array(sub, pa.string())], names=["obs", "category", "sub"])

    return points.mapInArrow(assign, f"obs {kind(reference)}, category string, sub string")


def _centered(reference: DataFrame, labels: DataFrame, centers: int) -> tuple[DataFrame, DataFrame]:
    """(means (obs, var, value), masses (sub, category, n, reads)) of the reference's sub-categories."""
    subs = cut(multi_center(labels, reference, centers))
    reads = reference.groupBy("obs").agg(F.sum("value").alias("t"))
    masses = subs.join(reads, "obs").groupBy("sub", "category").agg(F.count("*").alias("n"), F.sum("t").alias("reads"))
    means = reference.join(subs, "obs").groupBy(F.col("sub").alias("obs"), "var").agg(F.sum("value").alias("s")).join(F.broadcast(masses.select(F.col("sub").alias("obs"), "n")), "obs")  # a row a centre
    return means.select("obs", "var", (F.col("s") / F.col("n")).alias("value")), masses


def _by_category(ot: Transport, masses: pd.DataFrame, names: list[str], reads: bool, shape: str) -> DataFrame:
    cat = sorted(set(masses["category"]))
    at = masses.set_index("sub").loc[names]
    own = np.array([[float(c == d) for d in cat] for c in at["category"]])
    own = own * (at["reads"] / at["n"]).to_numpy()[:, None] if reads else own
    plan = ot.plan()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = plan(batch) @ own
                w = w / np.maximum(w.sum(1, keepdims=True), 1e-300)
                yield long(batch.column("obs"), cat, w, (w > 1e-12).ravel(), WEIGHTS)

    return ot.rows.mapInArrow(run, shape)


def annotate_wot(x: DataFrame, reference: DataFrame, labels: DataFrame, epsilon: float = 0.05, lambda1: float = 1.0, lambda2: float = 50.0, components: int = 30, centers: int = 20, rounds: int = 1000) -> DataFrame:
    """Unbalanced transport from observations to the reference, by squared distances on the principal components of both over
    their median; the plan's masses are summed by label. The reference takes part as at most ``centers`` centres a category
    with the masses of their members, so that costs grow with the observations only."""
    var = sorted(r[0] for r in x.select("var").distinct().union(reference.select("var").distinct()).distinct().collect())
    both = cut(packed(x.select("obs", "var", "value").unionByName(reference.select("obs", "var", "value")), var))
    ax, _, mean = axes(both, len(var), components, lambda r: r.block)
    means, masses = _centered(reference, labels, centers)
    m, mvar, names = small(means, "var", "obs", "value", "centres")
    full = np.zeros((len(names), len(var)))
    full[:, np.searchsorted(var, mvar)] = m.T
    c = (full - mean) @ ax

    def kernel(r: Rows) -> np.ndarray:
        z = (r.block - mean) @ ax
        return np.maximum(0, (z * z).sum(1)[:, None] + (c * c).sum(1) - 2 * z @ c.T)

    rows, _ = _costs(x, var, kernel)
    middle = rows.select(F.explode("d").alias("c")).agg(F.percentile_approx("c", 0.5, 10_000)).first()[0] or 1.0
    n = max(rows.count(), 1)
    scaled = cut(rows.select("obs", F.transform("d", lambda v: v / middle).alias("d"), F.lit(1.0 / n).alias("a")))
    mass = masses.toPandas()
    b = mass.set_index("sub").loc[names, "n"].to_numpy(float)
    ot = Transport(scaled, b / b.sum(), epsilon, lambda1, lambda2, rounds).solve()
    return _by_category(ot, mass, names, False, f"obs {kind(x)}, category string, weight double")


def annotate_novosparc(x: DataFrame, reference: DataFrame, labels: DataFrame, alpha: float = 1.0, reads: bool = False, epsilon: float = 5e-3, centers: int = 20, rounds: int = 1000) -> DataFrame:
    """Balanced transport from places to reference observations by the distance of their expression alone (alpha 1), every
    variable over its greatest value; masses summed by label, weighted by reads if ``reads``. The reference takes part as
    at most ``centers`` centres a category with the masses of their members."""
    if alpha != 1:
        raise NotImplementedError("only the cost linear in the plan (alpha = 1)")
    means, masses = _centered(reference, labels, centers)
    m, var, names = small(means, "var", "obs", "value", "centres")
    tops = {r[0]: r[1] for r in x.groupBy("var").agg(F.max("value")).collect()}  # a row a variable
    own, other = np.maximum(m.max(1), 1e-30), np.array([max(tops.get(v, 0.0), 1e-30) for v in var])
    c = (m / own[:, None]).T

    def kernel(r: Rows) -> np.ndarray:
        z = r.block / other
        return np.sqrt(np.maximum(0, (z * z).sum(1)[:, None] + (c * c).sum(1) - 2 * z @ c.T))

    rows, top = _costs(x, var, kernel)
    n = max(rows.count(), 1)
    scaled = cut(rows.select("obs", F.transform("d", lambda v: v / top).alias("d"), F.lit(1.0 / n).alias("a")))
    mass = masses.toPandas()
    b = mass.set_index("sub").loc[names, "n"].to_numpy(float)
    ot = Transport(scaled, b / b.sum(), epsilon, None, None, rounds).solve()
    return _by_category(ot, mass, names, reads, f"obs {kind(x)}, category string, weight double")


METHODS: dict[str, Method] = {"nnls": annotate_nnls, "projection": annotate_projection, "OT": annotate_ot}
#: Methods that need the reference's observations: (x, reference, labels).
DIRECT = {"svm": annotate_svm, "NMFreg": annotate_nmf, "WOT": annotate_wot, "novosparc": annotate_novosparc}


def unavailable(name: str):
    def run(*_, **__):
        raise NotImplementedError(f"{name} needs an external program that isn't part of this engine")

    return run


EXTERNAL = {n: unavailable(n) for n in ("tangram", "RCTD", "SingleR", "umap", "tsne")}


@dataclass(frozen=True)
class Annotation:
    """What an annotation makes: the soft labels; those of the sub-categories with their profiles and mapping (sub, category), from
    which counts are reconstructed (``split.reconstruct``); and the reference after platform normalisation, with the
    values of variables (``gene_values``) scaled along."""

    weights: DataFrame
    parts: DataFrame
    profiles: DataFrame
    mapping: DataFrame | None
    reference: DataFrame
    gene_values: dict[str, DataFrame]


def annotate(x: DataFrame, reference: DataFrame, labels: DataFrame, method: str | Method = "OT", **kw) -> DataFrame:
    """Soft labels (obs, category, weight) of x from a labelled reference: the weights of ``annotation``."""
    return annotation(x, reference, labels, method, **kw).weights


def annotation(
    x: DataFrame,
    reference: DataFrame,
    labels: DataFrame,
    method: str | Method = "OT",
    bisections: int | None = None,
    bisection_divisor: int = 3,
    max_annotation: int = 0,
    multi_centers: int = 0,
    multi_center_amplitudes: bool = True,
    platform_iterations: int | None = None,
    normalize_to: str = "adata",
    prior: DataFrame | Callable | None = None,
    min_counts_per_gene: float | None = None,
    min_counts_per_cell: float | None = None,
    min_cells_per_gene: int | None = None,
    min_genes_per_cell: int | None = None,
    remove_constant_genes: bool = True,
    remove_zero_cells: bool = True,
    min_log2foldchange: float | None = None,
    min_expression: float | None = None,
    remove_mito: bool | str = False,
    n_hvg: int | None = None,
    assume_valid_counts: bool = True,
    gene_values: dict[str, DataFrame] | None = None,
    **kw,
) -> Annotation:
    """Annotation of x from a labelled reference, on the variables of both that pass the filters.

    Composed from inside out: the method, bisection (by default 4 for OT, else 0), sub-clustering of categories (a ``prior`` is
    divided equally among them), platform normalisation (a first one and ``platform_iterations`` more; by default 0 for OT
    and projection, else -1, none) of the reference to x ('adata') or of x to the reference ('reference'), keeping the
    strongest labels. ``prior`` is (category, prior) or a function of (x, reference, labels) that gives it. ``gene_values``
    are (var, value) or (var, category, p) tables that are scaled along with the reference."""
    from lodestone.operators.platform import normalize_platform

    if method in EXTERNAL:
        EXTERNAL[method]()
    if normalize_to not in ("adata", "reference"):
        raise ValueError(f"normalize_to is 'adata' or 'reference', not {normalize_to!r}")
    x, reference = x.select("obs", "var", "value"), reference.select("obs", "var", "value")
    labels = labels.filter("category is not null").select("obs", "category")
    if not assume_valid_counts and not qc.counts_validity(x).first()["valid"]:
        raise ValueError("counts are negative or not whole; assume_valid_counts=True lets them pass")
    x, reference = x.filter("value > 0"), reference.filter("value > 0")
    if min_log2foldchange is not None or min_expression is not None or remove_mito:
        good = qc.filter_reference_genes(reference, labels, min_log2foldchange, min_expression, ("mt-" if remove_mito is True else remove_mito) or None)
        reference = reference.join(good, "var", "left_semi")
    if n_hvg is not None:
        top = qc.highly_variable(E.log_normalize(reference), reference.select("obs").distinct().count(), n_hvg)
        reference = reference.join(top.select("var"), "var", "left_semi")
    common = cut(x.select("var").distinct().join(reference.select("var").distinct(), "var", "left_semi"))
    side = F.broadcast(common) if common.count() <= 1_000_000 else common.hint("merge")
    x, reference = (cut(d.join(side, "var", "left_semi")) for d in (x, reference))
    if any(v is not None for v in (min_counts_per_gene, min_counts_per_cell, min_cells_per_gene, min_genes_per_cell)) or remove_constant_genes:
        x, reference = qc.filter_fixpoint([x, reference], min_counts_per_gene, min_counts_per_cell, min_cells_per_gene, min_genes_per_cell, remove_constant_genes, remove_zero_cells)
    labels = labels.join(reference.select("obs").distinct(), "obs", "left_semi")
    if not x.take(1) or not labels.take(1):
        raise ValueError("nothing is left to annotate: no observation or no labelled reference shares a variable that passes the filters")
    if bisections is None:
        bisections = 4 if method == "OT" else 0
    if platform_iterations is None:
        platform_iterations = 0 if method in ("OT", "projection") else -1
    given = prior(x, reference, labels) if callable(prior) else prior

    def once(x: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
        """(weights, weights of the parts, profiles of the parts, mapping)."""
        used, mapping, share = labels, None, given
        if multi_centers > 1:
            subs = cut(multi_center(labels, reference, multi_centers, multi_center_amplitudes))
            mapping = cut(subs.select("sub", "category").distinct())
            used = subs.select("obs", F.col("sub").alias("category"))
            if given is not None:
                n = mapping.groupBy("category").agg(F.count("*").alias("n"))
                share = mapping.join(given, "category").join(n, "category").select(F.col("sub").alias("category"), (F.col("prior") / F.col("n")).alias("prior"))
        profiles = cut(reference_profiles(reference, used))
        if share is None:
            share = category_priors(reference, used.withColumn("weight", F.lit(1.0)))
        if method in DIRECT:
            step = lambda a, p, q: DIRECT[method](a, reference, used, **kw)
        else:
            base = METHODS[method] if isinstance(method, str) else method
            step = (lambda a, p, q: base(a, p, q, **kw)) if kw else base
        if bisections:
            step = bisect(step, bisections, bisection_divisor)
        parts = cut(step(x, profiles, share))
        if mapping is None:
            return parts, parts, profiles, None
        out = parts.join(F.broadcast(mapping.withColumnRenamed("category", "main").withColumnRenamed("sub", "category")), "category")  # a row a centre
        return cut(out.groupBy("obs", F.col("main").alias("category")).agg(F.sum("weight").alias("weight"))), parts, profiles, mapping

    result = None
    factors = None
    data, scaled = x, reference
    for k in range(max(0, platform_iterations) + 1):
        if platform_iterations >= 0:
            soft = None if result is None else result[0]
            hard = labels.withColumn("weight", F.lit(1.0)) if soft is not None else None
            if normalize_to == "adata":
                factors = cut(normalize_platform(reference, labels if soft is not None else None, x, soft, return_factors=True))
                scaled = cut(E.scale(reference, factors, "var", fill=0.0).filter("value > 0"))
            else:
                factors = cut(normalize_platform(x, soft, reference, hard, return_factors=True))
                data = cut(E.scale(x, factors, "var", fill=0.0).filter("value > 0"))
        result = once(data, scaled)
    weights, parts, profiles, mapping = result
    values = dict(gene_values or {})
    if factors is not None and normalize_to == "adata":
        values = {n: _scale_along(d, factors) for n, d in values.items()}
    if max_annotation:
        weights = cut(E.max_annotation(weights, max_annotation))
        if mapping is None:
            parts = weights
        else:
            kept = weights.select("obs", F.col("category").alias("main"))
            parts = parts.join(F.broadcast(mapping.select(F.col("sub").alias("category"), F.col("category").alias("main"))), "category").join(kept, ["obs", "main"], "left_semi").select("obs", "category", "weight")  # a row a centre
            parts = E.normalise(parts, "obs", "weight")
    return Annotation(weights, parts, profiles, mapping, scaled, values)


def _scale_along(values: DataFrame, factors: DataFrame) -> DataFrame:
    """Values of variables times their factor; without one they become 0."""
    column = "p" if "p" in values.columns else "value"
    out = values.join(factors.withColumnRenamed("factor", "_f"), "var", "left")
    return out.withColumn(column, F.col(column) * F.coalesce("_f", F.lit(0.0))).drop("_f")
