"""Byte-level BPE encoding and decoding of texts of any length.

Long texts are cut into overlapping chunks that tasks pre-tokenise in
parallel.  A chunk may begin inside a pre-token, so its first boundaries can
be wrong; but the pattern never looks back, so from the first boundary that
it shares with the chunk before it, inside their overlap, all its boundaries
are right.  There the two are stitched, and each chunk encodes the pre-tokens
of its own stretch.  A text whose chunks share no boundary (one endless word),
or with characters that engines may class otherwise, is encoded as a whole.
All encoding runs on one engine, that of tiktoken.  Decoding concatenates the raw bytes of the ids.

Defined results: a null text is the empty text, with no ids; rows are encoded
one by one, so repeated rows repeat; long texts are told apart by a row
number, not by their id, which may repeat or be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole, written
from .tokens import byte_bpe, settled

#: White space as the rank files' own pattern engine has it; Python's ``\s`` takes in four control characters more.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens of a chunk after its first, but for those behind white space.

    The end of a chunk may cut a pre-token, so the match that touches it tells
    nothing.  A text that ends in white space can be cut otherwise than as a
    part of a longer one, so no stretch ends so.
    """
    return [m.end() for m in _PRE.finditer(text) if m.end() < len(text) and not text[m.end() - 1].isspace()]


def encode(docs: DataFrame, vocabulary: str, chunk: int = 32_768, overlap: int = 2_048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: ids as binary, little-endian unsigned, 2 bytes each where the vocabulary allows, else 4."""
    if not 0 < overlap <= chunk // 2:
        raise ValueError("overlap must be at most half a chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    short = F.length("text") <= chunk

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        for batch in batches:
            ids = [encoder.encode(t.as_py()).astype(encoder.stored).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    done = rows.filter(short).mapInArrow(direct, "doc_id long, ids binary")

    # Chunk k holds the characters from k * chunk, and `overlap` more; a text that engines may cut otherwise is one chunk.
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                parts = [text[at : at + chunk + overlap] for at in range(0, len(text), chunk)] if settled(text) else [text]
                n = len(parts)
                for k in range(0, n, 64):
                    some = parts[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(some), pa.int64()), pa.array([row.as_py()] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int64()), pa.array([n - 1] * len(some), pa.int64()), pa.array(some)], ["doc_id", "row", "k", "last", "part"])

    long = rows.filter(~short).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text")
    chunks = written(long.mapInArrow(split, "doc_id long, row long, k long, last long, part string").repartition("row", "k"), "chunks")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, ends = [], [], []
            for k, part in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                part = part.as_py()
                found = boundaries(part)
                heads.append([k * chunk + b for b in found if b <= overlap])
                tails.append([k * chunk + b for b in found if b >= chunk])
                ends.append(k * chunk + len(part))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())), pa.array(ends, pa.int64())], ["row", "k", "last", "head", "tail", "until"])

    # Only the boundaries of the overlaps meet; the chunks stay where they are until their stretch is known.
    marked = chunks.select("row", "k", "last", "part").mapInArrow(mark, "row long, k long, last long, head array<long>, tail array<long>, until long")
    order = Window.partitionBy("row").orderBy("k")
    same = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    stitched = marked.withColumn("at", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(same))
    stitched = stitched.withColumn("end", F.when(F.col("k") == F.col("last"), F.col("until")).otherwise(F.lead("at").over(order)))
    stitched = stitched.withColumn("whole", F.min((F.col("at").isNotNull() & F.col("end").isNotNull() & (F.col("at") <= F.col("end"))).cast("int")).over(Window.partitionBy("row")) == 1)
    stitched = written(stitched.select("row", "k", "at", "end", "whole"), "stitched")
    placed = chunks.join(stitched, ["row", "k"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        for batch in batches:
            got = []
            for k, part, at, end in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                # The stretch begins and ends at true boundaries, so it is encoded as in the whole text.
                got.append(encoder.encode(part[at - k * chunk : end - k * chunk]).astype(encoder.stored).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got, pa.binary())], ["doc_id", "row", "k", "ids"])

    parts = placed.filter("whole").select("doc_id", "row", "k", "part", "at", "end").mapInArrow(pieces, "doc_id long, row long, k long, ids binary")
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))

    def concat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    stitched_docs = joined.select("doc_id", "parts").mapInArrow(concat, "doc_id long, ids binary")

    # Without a shared boundary somewhere: the whole text again, from its chunks.
    endless = placed.filter("NOT whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", F.expr(f"if(k = last, part, substring(part, 1, {chunk}))").alias("part")))).alias("parts"))
    endless = endless.select("doc_id", F.array_join(F.col("parts.part"), "").alias("text")).mapInArrow(direct, "doc_id long, ids binary")
    return done.unionByName(stitched_docs).unionByName(endless)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, data``: the raw bytes that the ids stand for."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        for batch in batches:
            data = [encoder.decode(np.frombuffer(x.as_py(), encoder.stored).tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(joined, "doc_id long, data binary")


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], []]
            for x in batch.column(1):
                ids = np.frombuffer(x.as_py(), encoder.stored).tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(encoder.digits.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(summed, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def text_of(data: Column) -> Column:
    """Decoded bytes as text."""
    return F.decode(data, "UTF-8")
