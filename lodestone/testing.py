"""Assertions on DataFrames and annotated frames, and timing of a call."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestone.frame import AnnotatedFrame


def assert_frame_equal(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> None:
    """Equal columns in any order and equal rows in any order; numbers up to the tolerances."""
    assert sorted(a.columns) == sorted(b.columns), (a.columns, b.columns)
    key = lambda r: tuple((v is None, str(type(v)), round(v, 6) if isinstance(v, float) else v if v is not None else 0) for v in r)
    names = sorted(a.columns)
    left, right = (sorted((tuple(r) for r in d.select(*names).collect()), key=key) for d in (a, b))
    assert len(left) == len(right), (len(left), len(right))
    for x, y in zip(left, right):
        for n, u, v in zip(names, x, y):
            same = abs(u - v) <= atol + rtol * abs(v) if isinstance(u, float) and isinstance(v, float) and u == u and v == v else u == v or (u != u and v != v)
            assert same, (n, x, y)


def assert_annotated_equal(a: AnnotatedFrame, b: AnnotatedFrame, **kw) -> None:
    assert_frame_equal(a.counts, b.counts, **kw)
    for name in ("obs", "var"):
        x, y = getattr(a, name), getattr(b, name)
        assert (x is None) == (y is None), name
        if x is not None:
            assert_frame_equal(x, y, **kw)
    for part in ("obsm", "varm", "obsp", "layers", "uns"):
        x, y = getattr(a, part), getattr(b, part)
        assert x.keys() == y.keys(), part
        for k in x:
            assert_frame_equal(x[k], y[k], **kw)


def measure(call: Callable[[], DataFrame]) -> dict[str, float]:
    """Wall seconds of computing a DataFrame, and the driver's greatest resident memory in GB."""
    began = time.perf_counter()
    call().write.format("noop").mode("overwrite").save()
    return {"time_s": time.perf_counter() - began, "max_mem_usage_GB": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6}
