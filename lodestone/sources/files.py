"""Sources and sinks: annotated frames as folders of parquet files, and tab-separated tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lodestone.frame import AnnotatedFrame

PARTS = ("obsm", "varm", "obsp", "layers", "uns")


def write_frame(frame: AnnotatedFrame, path: str, mode: str = "overwrite") -> None:
    """counts, obs, var and every named part, each a parquet table below ``path``."""
    for name in ("counts", "obs", "var"):
        d = getattr(frame, name)
        if d is not None:
            d.write.mode(mode).parquet(os.path.join(path, name))
    for part in PARTS:
        for key, d in getattr(frame, part).items():
            d.write.mode(mode).parquet(os.path.join(path, part, key))
    if frame.raw is not None:
        write_frame(frame.raw, os.path.join(path, "raw"), mode)


def read_frame(spark: SparkSession, path: str) -> AnnotatedFrame:
    """A folder written by ``write_frame``. Listing uses the folder's file system, so any Hadoop path works."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(p):
        q = jvm.org.apache.hadoop.fs.Path(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(q)) if fs.exists(q) else []

    here = names(path)
    table = lambda *p: spark.read.parquet(os.path.join(path, *p))
    parts = {part: {k: table(part, k) for k in names(os.path.join(path, part))} for part in PARTS if part in here}
    return AnnotatedFrame(table("counts"), *[table(n) if n in here else None for n in ("obs", "var")], raw=read_frame(spark, os.path.join(path, "raw")) if "raw" in here else None, **parts)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_molecules(spark: SparkSession, path: str, x: str, y: str, gene: str) -> DataFrame:
    """(obs, x, y, gene) of a CSV file of molecules."""
    d = spark.read.option("header", True).csv(path)
    from pyspark.sql import functions as F

    return d.select(F.monotonically_increasing_id().cast("string").alias("obs"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(gene).alias("gene"))
