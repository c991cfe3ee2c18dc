"""Conversion of counts between species by classes of homologous genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.elementwise import normalise

TAXA = {"human": 9606, "mouse": 10090, "rat": 10116}


def taxon(name: str | int) -> int:
    return TAXA[name] if isinstance(name, str) and name in TAXA else int(name)


def read_homology(spark: SparkSession, path: str) -> DataFrame:
    """(key, taxon, symbol, synonyms) of a tab-separated homology report."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    key = "DB Class Key" if "DB Class Key" in raw.columns else "HomoloGene ID"
    synonyms = F.col("`Synonyms`") if "Synonyms" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.col(f"`{key}`").cast("long").alias("key"), F.col("`NCBI Taxon ID`").cast("int").alias("taxon"), F.col("`Symbol`").alias("symbol"), synonyms.alias("synonyms"))


def incidence(homology: DataFrame, tax: str | int, use_synonyms: bool = False) -> DataFrame:
    """(name, key) of a taxon, each once; with synonyms (separated by |) as names too."""
    rows = homology.filter(F.col("taxon") == taxon(tax)).filter("key is not null and symbol is not null")
    own = rows.select(F.col("symbol").alias("name"), "key")
    if use_synonyms:
        own = own.union(rows.select(F.explode(F.split("synonyms", r"\|")).alias("name"), "key").filter("name <> ''"))
    return own.distinct()


def conversion(homology: DataFrame, source: str | int, target: str | int, symbols: DataFrame | None = None, use_synonyms: bool = False) -> DataFrame:
    """(source, target, weight): a source gene is shared evenly by its classes, a class evenly by its target genes."""
    a = incidence(homology, source, use_synonyms).withColumn("one", F.lit(1.0))
    b = incidence(homology, target, use_synonyms).withColumn("one", F.lit(1.0))
    if symbols is not None:
        b = b.join(symbols.select(F.col("var").alias("name")), "name", "left_semi")
    b = normalise(b, "key", "one")
    a = a.join(b.select("key").distinct(), "key", "left_semi")
    a = normalise(a, "name", "one")
    return a.select(F.col("name").alias("source"), "key", F.col("one").alias("wa")).join(b.select(F.col("name").alias("target"), "key", F.col("one").alias("wb")), "key").groupBy("source", "target").agg(F.sum(F.col("wa") * F.col("wb")).alias("weight"))


def convert(x: DataFrame, table: DataFrame) -> DataFrame:
    """Counts with variables converted; variables without homologue drop out."""
    return x.join(table, x.var == table.source).groupBy("obs", F.col("target").alias("var")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
