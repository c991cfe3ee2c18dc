"""Principal components of long matrices, from covariances summed over partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import qc
from lodestone.operators.elementwise import log_normalize
from lodestone.operators.packed import Rows, axes, kind, packed, per_block, summed
from lodestone.runtime import cut


def variables(x: DataFrame) -> list[str]:
    return sorted(r[0] for r in x.select("var").distinct().collect())  # the width of the matrix


def pca(x: DataFrame, k: int, center: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(axes, variances, variables): the k first axes, from covariances or, of many variables, by subspace iteration."""
    var = variables(x)
    vectors, values, _ = axes(cut(packed(x, var)), len(var), k, lambda r: r.block, center)
    return vectors, values, var


def project(x: DataFrame, axes: np.ndarray, var: list[str]) -> DataFrame:
    """(obs, scores) on given axes; to transfer components of a reference to other data, use the reference's axes."""

    def run(r: Rows) -> pa.RecordBatch:
        z = r.block @ axes
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
        return pa.RecordBatch.from_arrays([r.names, lists], names=["obs", "scores"])

    return per_block(packed(x, var), len(var), run, f"obs {kind(x)}, scores array<double>")


def preprocess_single_cell(x: DataFrame, top: int = 2000, components: int = 10, min_cells: int = 10, min_genes: int = 10, scale: bool = True, limit: float = 10.0) -> DataFrame:
    """(obs, scores): filter, scale to 10,000, log1p, variable genes, optionally every variable scaled to mean 0 and variance 1 (at most
    ``limit``), principal components."""
    (good,) = qc.filter_fixpoint([x], min_cells_per_gene=min_cells, min_genes_per_cell=min_genes)
    logs = log_normalize(good)
    variable = qc.highly_variable(logs, good.select("obs").distinct().count(), top)
    kept = logs.join(F.broadcast(variable.select("var")), "var")  # at most ``top`` rows
    var = variables(kept)
    rows = cut(packed(kept, var))
    change = lambda r: r.block
    if scale:
        s = summed(rows, len(var), lambda r: np.stack([r.block.sum(0), (r.block**2).sum(0), np.full(len(var), float(len(r.names)))], 1), len(var), 3)
        n = np.maximum(s[:, 2], 2)
        mean = s[:, 0] / n
        sd = np.sqrt(np.maximum((s[:, 1] - n * mean**2) / (n - 1), 1e-12))
        change = lambda r: np.minimum(limit, (r.block - mean) / sd)
    vectors, _, middle = axes(rows, len(var), components, change)

    def run(r: Rows) -> pa.RecordBatch:
        z = (change(r) - middle) @ vectors
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
        return pa.RecordBatch.from_arrays([r.names, lists], names=["obs", "scores"])

    return per_block(rows, len(var), run, f"obs {kind(kept)}, scores array<double>")
