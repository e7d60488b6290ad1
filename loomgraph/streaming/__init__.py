"""Run metrics while a run goes on: per-step figures over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "run string, step int, worker bigint, ts timestamp, metric string, value double"


def read_samples(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of node samples from Parquet files that arrive in ``path``."""
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_statistics(samples: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Mean, deviation and count of each metric by worker and window of time; samples later than ``late`` are left out."""
    timed = samples.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", window), "run", "worker", "metric")
    return grouped.agg(F.avg("value").alias("average"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n")).select(F.col("window.start").alias("start"), "run", "worker", "metric", "average", "std", "n")
