"""Tokens of texts: a token is a match of ``\\w+|[^\\w\\s]+`` with Unicode letters and digits as word characters.

Texts are classified by code point in numpy, whole, slice by slice; a null text has no tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters classified at once.
SLICE = 2_000_000


def class_table() -> np.ndarray:
    """0 white space, 1 word, 2 other, of the first 65,536 code points."""
    return np.array([0 if (c := chr(i)).isspace() else 1 if c.isalnum() or c == "_" else 2 for i in range(0x10000)], np.uint8)


def classify(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    kind = table[np.minimum(code, 0xFFFF)]
    if len(code) and code.max() > 0xFFFF:
        high = np.flatnonzero(code > 0xFFFF)
        names, at = np.unique(code[high], return_inverse=True)
        kind[high] = np.array([0 if (c := chr(i)).isspace() else 1 if c.isalnum() else 2 for i in names], np.uint8)[at]
    return kind


def tally(texts: list, table: np.ndarray, capacity: int):
    """Token counts, shares of word characters, and for texts of over ``capacity`` tokens the offsets (in characters)
    of every capacity-th token."""
    joined = "\n".join(t or "" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classify(code, table)
    start = kind != 0
    start[1:] &= kind[1:] != kind[:-1]
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    begins = ends - [len(t or "") + 1 for t in texts]
    upto = np.concatenate([[0], np.cumsum(start, dtype=np.int64), [0]])
    upto[-1] = upto[-2]
    n = upto[ends] - upto[begins]
    word = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int64), [0]])
    word[-1] = word[-2]
    solid = np.concatenate([[0], np.cumsum(kind != 0, dtype=np.int64), [0]])
    solid[-1] = solid[-2]
    share = (word[ends] - word[begins]) / np.maximum(1, solid[ends] - solid[begins])
    cuts = [[] if k <= capacity else (np.flatnonzero(start[b:e])[capacity::capacity]).tolist() for k, b, e in zip(n, begins, ends)]
    return n, share, cuts


def with_tokens(df: DataFrame, text: str, keep: list[str], capacity: int = 0) -> DataFrame:
    """``keep`` columns, n_tokens, word_share (word characters among all but white space; 0 for none) and, if
    ``capacity`` is given, cuts: the offsets at which a text of more than ``capacity`` tokens divides."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    limit = capacity or 1 << 62

    def count(batches):
        table = class_table()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            parts, at, size = [], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "") + 1
                if size > SLICE or k == len(texts) - 1:
                    parts.append(tally(texts[at : k + 1], table, limit))
                    at, size = k + 1, 0
            if not parts:
                continue
            columns = [*kept, pa.array(np.concatenate([p[0] for p in parts]), pa.int64()), pa.array(np.concatenate([p[1] for p in parts]), pa.float64())]
            columns.append(pa.array([c for p in parts for c in p[2]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens", "word_share", "cuts"])

    out = source.mapInArrow(count, f"{fields}, n_tokens long, word_share double, cuts array<int>")
    return out if capacity else out.drop("cuts")
