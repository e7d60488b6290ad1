"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after every run of ASCII white space
is replaced by one space.  A first scan gives (length, prefix hash) of each
row; groups of one length, then of one length and prefix, that have a single
row are settled there.  Only rows of groups that survive both rounds have
their full content hashed and compared.

Only short keys are shuffled by ``exact_groups``.  ``keep_rows`` passes settled
rows on where they were read; only rows of surviving groups are moved.

Defined results: a null text counts as empty; an empty table gives an empty
result; rows with a null id form groups like others but never give the id that
stays unless the whole group has none; repeated rows all count in
``group_size`` and, sharing the id that stays, are all marked ``kept``
(``keep_rows`` leaves one of them).  Only the id and text columns are read, so
further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_names, with_group, written

#: A run of white space that isn't already one plain space.
_RUN = r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    """The text with each run of ``[\\x20\\x09-\\x0D]`` as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def _digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _survivors(keys: DataFrame, n: str, p: str) -> DataFrame:
    """``n, p, _rows``: the lengths, and prefixes there, that several rows share."""
    prefixes = written(keys.groupBy(n, p).agg(F.count("*").alias("_rows")), "dedup-prefixes")
    lengths = prefixes.groupBy(n).agg(F.sum("_rows").alias("_all")).filter("_all > 1").select(n)
    return prefixes.filter("_rows > 1").join(lengths, n, "left_semi")


#: Surviving (length, prefix) groups up to this number, 12 bytes each, are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 2_000_000


def _split(keyed: DataFrame, n: str, p: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are settled by length and prefix hash, and those that survive."""
    groups = written(_survivors(written(keyed.select(n, p), "dedup-keys"), n, p).select(n, p), "dedup-survivors")
    small = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    return keyed.join(small, [n, p], "left_anti"), keyed.join(small, [n, p], "left_semi")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128, digest: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``text_sha256`` is null for rows settled without their full content, unless
    ``digest`` asks for it everywhere: then the first scan takes it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.select("doc_id", "_text", F.length("_text").alias("_n"), F.xxhash64(F.substring("_text", 1, prefix)).alias("_p"))
    full = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    if digest:
        keys = written(rows.select("doc_id", "_n", "_p", full), "dedup-keys")
        marked = written(with_group(keys, _survivors(keys, "_n", "_p"), ["_n", "_p"], "_rows"), "dedup-hashes")
        alone, alive = marked.filter("_rows IS NULL"), marked.filter("_rows IS NOT NULL").select("doc_id", "text_sha256")
    else:
        alone, alive = _split(rows, "_n", "_p")
        alone, alive = alone.select("doc_id", F.lit(None).cast("string").alias("text_sha256")), written(alive.select("doc_id", full), "dedup-hashes")

    groups = alive.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = with_group(alive, groups, ["text_sha256"], "group_size")
    return settled.unionByName(shared.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    n, p, sha, id_, keep = fresh_names(docs, "n", "p", "sha", "id", "keep")
    text = normalised(F.col(text_col))
    # Each key is computed from the text where it is read; the two columns drop out again.
    settled, alive = _split(docs.withColumns({n: F.length(text), p: F.xxhash64(F.substring(text, 1, prefix))}), n, p)
    alive = written(alive.withColumn(sha, _digest(F.col(text_col))).select(*docs.columns, sha), "dedup-alive")

    kept = alive.groupBy(F.col(sha).alias(keep)).agg(F.min(id_col).alias(id_))
    # By hash and id, so that the copies of a hot text are spread; then one of each repeated row.
    stay = alive.join(kept, (alive[sha] == kept[keep]) & alive[id_col].eqNullSafe(kept[id_]), "left_semi")
    return settled.select(*docs.columns).unionByName(stay.dropDuplicates([sha, id_col]).select(*docs.columns))
