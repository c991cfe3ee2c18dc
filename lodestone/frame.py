"""The annotated matrix as long DataFrames.

``counts(obs, var, value)`` holds the non-zero entries, ``obs`` and ``var`` one row for each observation and variable,
``obsm`` and ``varm`` soft labels ``(obs, category, weight)`` and profiles ``(var, category, p)`` by name, ``obsp`` edges
``(i, j, w)`` by name. Frames are immutable: operators return DataFrames, and ``replace`` makes a changed copy.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.nearby import latest
from lodestone.runtime import read


@dataclass(frozen=True)
class AnnotatedFrame:
    counts: DataFrame
    obs: DataFrame | None = None
    var: DataFrame | None = None
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    layers: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, DataFrame] = field(default_factory=dict)
    raw: "AnnotatedFrame | None" = None

    def replace(self, **changes) -> "AnnotatedFrame":
        return replace(self, **changes)

    def query(self, expression: str) -> "AnnotatedFrame":
        """The observations for which a boolean SQL expression over ``obs`` holds, with their counts and soft labels."""
        kept = self.obs.filter(F.expr(expression))
        ids = kept.select("obs")
        return self.replace(obs=kept, counts=self.counts.join(ids, "obs", "left_semi"), obsm={k: d.join(ids, "obs", "left_semi") for k, d in self.obsm.items()})

    def matrix(self, location: tuple | str | None = None) -> DataFrame:
        """The matrix at a path: 'X', ('layer', name), ('obsm', name), ('varm', name) or ('raw', *path)."""
        path = ("X",) if location is None else (location,) if isinstance(location, str) else tuple(location)
        if path[0] == "raw":
            if self.raw is None:
                raise KeyError("there is no raw frame")
            return self.raw.matrix(path[1:] or None)
        if path == ("X",):
            return self.counts
        if len(path) == 2 and path[0] == "layer":
            return self.layers[path[1]]
        if len(path) == 2 and path[0] == "obsm":
            return self.obsm[path[1]].select("obs", F.col("category").alias("var"), F.col("weight").alias("value"))
        if len(path) == 2 and path[0] == "varm":
            return self.varm[path[1]].select(F.col("category").alias("obs"), "var", F.col("p").alias("value"))
        raise KeyError(f"no matrix at {path}")

    def values(self, key, order: tuple[str, ...] = ("obs", "obsm", "var", "varm", "layer", "X"), unique: bool = True) -> DataFrame:
        """The data of a key. A path says where it is; a plain name is sought in ``order`` and must be found once if
        ``unique``. Resolution looks at column names and dictionaries only; no job runs, except for genes (X, layer)."""
        if isinstance(key, tuple):
            return self._at(key)
        hits = []
        for place in order:
            if place == "obs" and self.obs is not None and key in self.obs.columns:
                hits.append(("obs", key))
            elif place == "var" and self.var is not None and key in self.var.columns:
                hits.append(("var", key))
            elif place == "obsm" and key in self.obsm:
                hits.append(("obsm", key))
            elif place == "varm" and key in self.varm:
                hits.append(("varm", key))
            elif place == "layer" and key in self.layers:
                hits.append(("layer", key))
            elif place == "X" and not hits and self.counts.filter(F.col("var") == key).take(1):
                hits.append(("X", key))
        if not hits:
            raise KeyError(f"{key!r} is neither of {order}")
        if unique and len(hits) > 1:
            raise KeyError(f"{key!r} is ambiguous: {hits}")
        return self._at(hits[0])

    def _at(self, path: tuple) -> DataFrame:
        place, *rest = path
        if place == "raw":
            return self.raw._at(tuple(rest))
        if place in ("obs", "var") and len(rest) == 1:
            names = [rest[0]] if isinstance(rest[0], str) else list(rest[0])
            return getattr(self, place).select(place, *names)
        if place in ("obsm", "varm"):
            d = getattr(self, place)[rest[0]]
            return d if len(rest) == 1 else d.filter(F.col("category") == rest[1])
        if place == "X":
            return self.counts.filter(F.col("var").isin([rest[0]] if isinstance(rest[0], str) else list(rest[0])))
        if place == "layer":
            d = self.layers[rest[0]]
            return d if len(rest) == 1 else d.filter(F.col("var").isin([rest[1]] if isinstance(rest[1], str) else list(rest[1])))
        raise KeyError(f"no data at {path}")

    def soft(self, key: str) -> DataFrame:
        """(obs, category, weight) of a key: soft labels as they are, hard labels with weight 1, nulls left out."""
        if key in self.obsm:
            return self.obsm[key]
        return one_hot(self.obs.select("obs", F.col(key).alias("category")))

    def positions(self, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
        return self.obs.select("obs", *columns)


def one_hot(labels: DataFrame) -> DataFrame:
    """(obs, category, weight = 1) of (obs, category)."""
    return labels.filter("category is not null").select("obs", F.col("category").cast("string").alias("category"), F.lit(1.0).alias("weight"))


def unused_key(columns, base: str = "key") -> str:
    """A name not among ``columns``."""
    name, n = base, 0
    while name in columns:
        name, n = f"{base}_{n}", n + 1
    return name


def plain_label(c):
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s\p{Z}_-]+", ""), F.lit(""))


def all_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs, var, value) of the count matrix: positive values, with repeated rows."""
    return read(spark, sf_dir, "counts").filter("obs is not null and var is not null and value > 0 and not isnan(value)").select("obs", "var", "value")


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs, var, value) of the count matrix: positive values, repeated rows once."""
    c = all_counts(spark, sf_dir)
    return c.groupBy("obs", "var").agg(F.max("value").alias("value"))


def clean_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs, sample, section, x, y, category) of current rows; the label in the spelling of the categories."""
    names = read(spark, sf_dir, "categories").select(plain_label(F.col("annotation_key")).alias("p"), F.col("annotation_key").alias("category"))
    now = latest(read(spark, sf_dir, "obs").select("obs", "sample", "section", "x", "y", "annotation_key", "loaded_at"), "obs", "loaded_at")
    return now.withColumn("p", plain_label(F.col("annotation_key"))).join(names, "p", "left").select("obs", "sample", "section", "x", "y", "category")


def clean_frame(spark: SparkSession, sf_dir: str) -> AnnotatedFrame:
    return AnnotatedFrame(clean_counts(spark, sf_dir), clean_obs(spark, sf_dir))
