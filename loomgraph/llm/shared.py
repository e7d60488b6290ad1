"""What several operators need: the shared folder, written stages and small text helpers."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master, where there is but one machine, may do without the
    setting; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no result is read from any more."""
    for df in tables:
        if (found := _PATHS.pop(df, None)) is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows never teach a label."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def whole(text_col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text_col), F.lit(""))


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


#: A group with a share of the rows of at least one in so many is large; there are no more large groups than that.
LARGE = 1_000


def with_group(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group, null for rows without one.

    ``groups`` has one row for each value of ``on``, which isn't null, and in
    ``size`` the number of its rows.  Groups with a thousandth of all grouped
    rows are at most a thousand and are broadcast, so no task gets a hot group;
    the others are joined by a shuffle.
    """
    groups = written(groups, "groups")
    total = groups.agg(F.sum(size)).first()[0] or 0
    others = [c for c in groups.columns if c not in on]
    large = F.broadcast(groups.filter(F.col(size) * LARGE >= total).withColumns({f"{c}_large": F.col(c) for c in others}).drop(*others))
    found = rows.join(large, on, "left")
    # Rows of large groups get a further key of many values, so the shuffle spreads them.
    spread = F.when(F.col(f"{size}_large").isNotNull(), 1 + F.monotonically_increasing_id() % 4096).otherwise(F.lit(0))
    small = groups.filter(F.col(size) * LARGE < total).withColumn("_spread", F.lit(0).cast("long"))
    both = found.withColumn("_spread", spread).join(small, [*on, "_spread"], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(f"{c}_large"), F.col(c)).alias(c) for c in others])
