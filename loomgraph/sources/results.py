"""Directories of benchmark results: property files and logs, read in parallel.

A result directory holds ``benchmark.properties`` (the run), one property file
for its graph, a benchmark log, and container logs.  Results whose log doesn't
say that validation succeeded, or that lack a figure, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALID = "Validation successful"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    file = F.col("_metadata.file_path")
    return spark.read.option("recursiveFileLookup", "true").text(path).select("value", file.alias("file"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, text`` of each property line; comments and lines without ``=`` or ``:`` are left out."""
    pair = F.regexp_extract("value", r"^\s*([^#!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*$", 1)
    text = F.regexp_extract("value", r"^\s*([^#!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*$", 2)
    return _lines(spark, path).select("file", pair.alias("key"), text.alias("text")).filter("key <> ''")


def short_policy(name: Column) -> Column:
    """The short name of a policy's class."""
    last = F.substring_index(name, ".", -1)
    out = F.when(last.isin("AKTE", "ConPaaS", "Reg", "React", "Hist"), last)
    for known, short in (("WallClockPolicy", "WCP"), ("CPUPolicy", "CPU"), ("CPUPolicyV2", "CPUv2"), ("NetworkPolicy", "NP")):
        out = out.when(last == known, short)
    return out.otherwise("UNKNOWN")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, valid, processing_ms, makespan_ms`` of benchmark logs; times are null where a log has none."""
    processing = F.when(F.startswith("value", F.lit("ProcessingTime")), F.trim(F.get(F.split("value", ":"), F.lit(1))).try_cast("bigint"))
    makespan = F.regexp_extract("value", r"took (\d+) ms\.$", 1).try_cast("bigint")
    return _lines(spark, path).groupBy("file").agg(F.bool_or(F.contains("value", F.lit(VALID))).alias("valid"), F.min(processing).alias("processing_ms"), F.min(makespan).alias("makespan_ms"))


def container_times(spark: SparkSession, path: str) -> DataFrame:
    """``file, first_ms, last_ms`` of container logs, whose lines begin with a level and a time in brackets."""
    stamp = F.regexp_extract("value", r"^\[[A-Z]+\] (?:\[SECURITY\] ?)?\[?(\d\d/\d\d/\d{4} \d\d:\d\d:\d\d\.\d{3})", 1)
    ms = F.unix_millis(F.try_to_timestamp(stamp, F.lit("MM/dd/yyyy HH:mm:ss.SSS")))
    return _lines(spark, path).filter(F.startswith("value", F.lit("["))).select("file", ms.alias("ms")).groupBy("file").agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each valid result below ``path``: dataset, algorithm, policy and figures, ready to group by dataset and algorithm.

    Undirected graphs' edges count twice; times are whole seconds.
    """
    folder = F.regexp_extract("file", r"^(.*?/[^/]+)/(?:config/.*|[^/]*)$", 1)
    settings = read_properties(spark, f"{path}/*/*.properties").withColumn("folder", folder)
    run = settings.groupBy("folder").agg(*[F.max(F.when(F.col("key") == key, F.col("text"))).alias(name) for key, name in (("benchmark.run.graphs", "dataset"), ("benchmark.run.algorithms", "algorithm"), ("job.policy.name", "policy_class"), ("job.max-worker-count", "max_workers"))])
    graphs = read_properties(spark, f"{path}/*/config/graphs/*.properties").withColumn("folder", folder)
    graph = graphs.withColumn("dataset", F.regexp_extract("key", r"^graph\.(.*?)\.(?:meta\.edges|meta\.vertices|directed)$", 1)).filter("dataset <> ''").groupBy("folder", "dataset")
    graph = graph.agg(*[F.max(F.when(F.endswith("key", F.lit(f".{key}")), F.col("text"))).alias(name) for key, name in (("meta.vertices", "vertices"), ("meta.edges", "edges"), ("directed", "directed"))])
    logs = read_logs(spark, f"{path}/*/*.log").withColumn("folder", folder).filter("valid AND processing_ms IS NOT NULL AND makespan_ms IS NOT NULL")
    both = run.filter("dataset IS NOT NULL AND algorithm IS NOT NULL").join(graph, ["folder", "dataset"]).join(logs.drop("file", "valid"), "folder")
    edges = F.when(F.col("directed").try_cast("boolean"), F.col("edges").try_cast("bigint")).otherwise(F.col("edges").try_cast("bigint") * 2)
    return both.select(
        "folder", "dataset", "algorithm", F.when(F.col("policy_class").isNotNull(), short_policy(F.col("policy_class"))).alias("policy"), F.coalesce(F.col("max_workers").try_cast("int"), F.lit(-1)).alias("max_workers"),
        F.col("vertices").try_cast("bigint").alias("vertices"), edges.alias("edges"), F.expr("processing_ms div 1000").alias("processing_s"), F.expr("makespan_ms div 1000").alias("makespan_s"),
    )
