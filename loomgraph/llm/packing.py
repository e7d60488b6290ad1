"""Packing by power-of-two decomposition.

A document of n tokens is cut into as many pieces of ``max_len`` as fit and,
for the rest, one piece for each bit of its length, longest first.  Each piece
is a training sequence of its own: it needs no padding, no sequence crosses
documents, and pieces of one length make a bucket from which batches of equal
shape are drawn.  Sequence ids run on within a bucket, so a bucket is one
range of ids.

Defined results: a null text is the empty text and gives one piece that holds
only the end id; repeated rows are packed like any others; an empty table
gives no pieces.  Further columns of the input aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole, written
from .tokens import byte_bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def cuts(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens; ``max_len`` is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its ids, as little-endian unsigned integers of 2 bytes where the vocabulary allows, else of 4."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        stored = encoder.stored if end_id < 1 << 16 else np.dtype("<u4")
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encoder.encode(text.as_py())
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                raw, kept, start = ids.tobytes(), ids.astype(stored), 0
                for length in cuts(len(ids), max_len):
                    end = start + length
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(raw[4 * start : 4 * end]), len(ids), kept[start:end].tobytes()), strict=True):
                        column.append(value)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [*[pa.int64()] * 5, pa.binary()], strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(cut, PIECES)


def number(cut: DataFrame, slots: int | None = None) -> DataFrame:
    """``sequence_id`` for each row of a written table of pieces: gapless, bucket after bucket.

    A bucket may hold most pieces, so it is counted in ``slots`` parts by the
    number ``row`` of the piece, whatever its document's id.  The parts' first
    ids come from at most ``11 * slots`` counts; ranks inside a part need no
    other part.
    """
    spark = cut.sparkSession
    slots = slots or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slotted = cut.withColumn("_slot", F.pmod(F.xxhash64("row"), F.lit(slots)))
    counts = slotted.groupBy("length", "_slot").count()
    before = F.sum("count").over(Window.orderBy(F.desc("length"), "_slot").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "_slot", F.coalesce(before, F.lit(0)).alias("_first"))  # at most 11 * slots rows
    rank = F.row_number().over(Window.partitionBy("length", "_slot").orderBy("row"))
    ranked = slotted.withColumn("_rank", rank).join(F.broadcast(first), ["length", "_slot"])
    return ranked.withColumn("sequence_id", F.col("_first") + F.col("_rank") - 1).drop("_slot", "_rank", "_first", "row")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as sequences: piece, bucket (its length), ``sequence_id``, ``offset`` and ids."""
    cut = written(pieces(docs, vocabulary, end_id, max_len, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return number(cut).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.col("length"))
