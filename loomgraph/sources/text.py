"""Graphs as text lines, and run metrics as Parquet.

An edge line is ``src dst`` or ``src dst weight``, split at each single white
space character; a vertex line is an id.  A line that doesn't parse fails the
read, or is left out if ``permissive``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _field(tokens: Column, i: int, kind: str) -> Column:
    return F.get(tokens, F.lit(i)).try_cast(kind)


def _strict(df: DataFrame, parsed: list[str], permissive: bool) -> DataFrame:
    fine = F.lit(True)
    for c in parsed:
        fine &= F.col(c).isNotNull()
    if permissive:
        return df.filter(fine).drop("value")
    checked = [F.when(fine, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("not a line of this format: "), F.col("value"))).cast(dict(df.dtypes)[c])).alias(c) if c in parsed else F.col(c) for c in df.columns if c != "value"]
    return df.select(*checked)


def read_edges(spark: SparkSession, path: str | list[str], weighted: bool = False, constant: bool | None = None, permissive: bool = False) -> DataFrame:
    """``src, dst`` and, if ``weighted`` or with a ``constant`` value, ``e``."""
    tokens = F.split("value", r"\s")
    lines = spark.read.text(path).select("value", _field(tokens, 0, "bigint").alias("src"), _field(tokens, 1, "bigint").alias("dst"), *([_field(tokens, 2, "double").alias("e")] if weighted else []))
    out = _strict(lines, ["src", "dst", *(["e"] if weighted else [])], permissive)
    return out if constant is None else out.withColumn("e", F.lit(constant))


def read_vertices(spark: SparkSession, path: str | list[str], permissive: bool = False) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("value").try_cast("bigint").alias("id"))
    return _strict(lines, ["id"], permissive)


def write_vertices(state: DataFrame, path: str, columns: tuple[str, ...] = ("id", "value"), separator: str = " ") -> None:
    """A line for each vertex, halted or not; one file for each partition, in place of what was there."""
    line = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    state.select(line.alias("value")).write.mode("overwrite").text(path)


def write_metrics(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_metrics(spark: SparkSession, path: str, names: tuple[str, ...] = ("worker_state", "node_metric", "supply_demand", "active_vertices")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
