"""Running aggregates over arriving counts (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A folder or file of parquet as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream reads a folder or a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_totals(counts: DataFrame, by: str = "var") -> DataFrame:
    """Sum and number of positive values by key; for outputMode('complete')."""
    fine = counts.filter("value > 0 and not isnan(value)")
    return fine.groupBy(by).agg(F.sum("value").alias("total"), F.count("*").alias("entries"))


def windowed_totals(events: DataFrame, at: str, by: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Number and sum of values by time window; rows later than ``late`` are left out once their window is closed."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Processes everything there is now and returns it as a table. The in-memory table is collected on the driver, so
    this is for aggregates of few keys; jobs write to files with ``writeStream`` instead."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
