"""Token ids in binary shards, each with a minimal perfect hash index.

Documents are range-partitioned by key and written in ascending order.  A
shard is one file of at most ``shard_ids`` ids (a longer document has a shard
to itself):

    header    64 bytes: magic, version, id width, keys, ids, levels, rows
    levels    for each level of the hash, its number of blocks (u4)
    index     the blocks of all levels: 512 bits, and the number of bits set before them
    slots     for each key: fingerprint u4, rows u4, first id u8, ids u8
    rows      for each document in order: key i8, ids u8
    payload   raw little-endian ids, 2 bytes each where the vocabulary allows, else 4

The minimal perfect hash puts each key at one bit of a level's bit array,
where no other remaining key falls, and sends the rest to the next level; the
number of bits set before a key's own is its slot.  A look-up reads one block
of a few levels, one slot and one slice of the payload, however many keys the
shard has; the stored fingerprint turns down keys that the shard doesn't hold.

Files have names of their own for each attempt, and only those in the
manifest, which Spark commits, count: a lost executor's half-written files are
never read.

Defined results: a null text is the empty text (one end id); null keys are
left out of the index but written first; rows that share a key lie side by
side, in as many shards as they fill, and a look-up gives them all; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, whole, written
from .tokens import word_bpe

MAGIC = b"LOOMIDS1"
_HEAD = struct.Struct("<8sHHIQII")
#: Part of a level: its bits, and the number of bits set before it, in this level and the ones above.
_BLOCK = np.dtype([("before", "<u8"), ("words", "<u8", 8)])
_SLOT = np.dtype([("print", "<u4"), ("rows", "<u4"), ("first", "<u8"), ("ids", "<u8")])
_ROW = np.dtype([("key", "<i8"), ("ids", "<u8")])
_NULL = np.iinfo(np.int64).min
MANIFEST = "part int, seq int, path string, first_key long, last_key long, documents long, ids long"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray, gamma: float = 1.5) -> list[np.ndarray]:
    """The blocks of each level for distinct ``keys``."""
    levels, left, before = [], keys, 0
    while len(left):
        blocks = np.zeros(max(1, int(np.ceil(len(left) * gamma / 512))), _BLOCK)
        at = (_mix(left, len(levels)) % np.uint64(512 * len(blocks))).astype(np.int64)
        alone = np.bincount(at, minlength=512 * len(blocks)) == 1
        blocks["words"] = np.packbits(alone, bitorder="little").view("<u8").reshape(-1, 8)
        own = np.bitwise_count(blocks["words"]).sum(1, dtype=np.uint64)
        blocks["before"] = before + np.cumsum(own) - own
        levels.append(blocks)
        left, before = left[~alone[at]], before + int(own.sum())
    return levels


def slots_of(sizes: list[int], read, keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for keys that fall on no set bit.

    ``sizes``: blocks of each level; ``read(level, numbers)`` gives blocks.
    """
    out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = (_mix(keys[left], level) % np.uint64(512 * size)).astype(np.int64)
        blocks, word, bit = read(level, at >> 9), (at >> 6) & 7, (at & 63).astype(np.uint64)
        own = blocks["words"][np.arange(len(at)), word]
        hit = (own >> bit) & np.uint64(1) == 1
        whole_words = (np.bitwise_count(blocks["words"]) * (np.arange(8) < word[:, None])).sum(1, dtype=np.int64)
        rank = whole_words + np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[hit]] = blocks["before"][hit].astype(np.int64) + rank[hit]
        left = left[~hit]
    return out


def shard_bytes(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One shard's file; ``keys`` ascend, nulls first."""
    rows = np.zeros(len(keys), _ROW)
    rows["key"] = [_NULL if k is None else k for k in keys]
    rows["ids"] = [len(x) for x in ids]
    starts = np.cumsum(rows["ids"], dtype=np.uint64) - rows["ids"]
    real = np.array([k is not None for k in keys], bool)
    unique, at, times = np.unique(rows["key"][real], return_index=True, return_counts=True)
    at = at + int((~real).sum())
    levels = build_mph(unique)
    slots = np.zeros(len(unique), _SLOT)
    if len(unique):
        sums = np.add.reduceat(rows["ids"], at) if len(at) else rows["ids"][:0]
        where = slots_of([len(x) for x in levels], lambda level, at: levels[level][at], unique)
        slots["print"][where] = _mix(unique, 99) >> np.uint64(32)
        slots["rows"][where], slots["first"][where], slots["ids"][where] = times, starts[at], sums
    index = b"".join([np.array([len(x) for x in levels], "<u4").tobytes(), *(x.tobytes() for x in levels)])
    payload = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(f"<u{width}").tobytes()
    head = _HEAD.pack(MAGIC, 2, width, len(unique), int(rows["ids"].sum()), len(levels), len(keys))
    return head.ljust(64, b"\0") + index + slots.tobytes() + rows.tobytes() + payload


class Shard:
    """A shard opened for keyed access; ``read_at(n, offset)`` gives its bytes."""

    def __init__(self, read_at):
        self._read = read_at
        magic, version, self.width, self.keys, self.ids, levels, self.n = _HEAD.unpack_from(read_at(64, 0))
        if magic != MAGIC or version != 2:
            raise ValueError("not a shard of token ids")
        self.sizes = np.frombuffer(read_at(4 * levels, 64), "<u4").tolist()
        self._index = 64 + 4 * levels
        self._slots = self._index + _BLOCK.itemsize * sum(self.sizes)
        self._rows = self._slots + _SLOT.itemsize * self.keys
        self._payload = self._rows + _ROW.itemsize * self.n

    def _block(self, level: int, at: np.ndarray) -> np.ndarray:
        """One block of a level: a read of 72 bytes."""
        number = sum(self.sizes[:level]) + int(at[0])
        return np.frombuffer(self._read(_BLOCK.itemsize, self._index + _BLOCK.itemsize * number), _BLOCK)

    def _take(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self._read(n * self.width, self._payload + first * self.width), f"<u{self.width}", n)

    def __getitem__(self, key: int) -> np.ndarray:
        """The ids of ``key``, of all its rows in this shard one after another: some blocks, one slot and one slice are read."""
        one = np.array([key], np.int64)
        at = int(slots_of(self.sizes, self._block, one)[0])
        if at < 0:
            raise KeyError(key)
        slot = np.frombuffer(self._read(_SLOT.itemsize, self._slots + _SLOT.itemsize * at), _SLOT)[0]
        if slot["print"] != (_mix(one, 99) >> np.uint64(32))[0]:
            raise KeyError(key)
        return self._take(int(slot["first"]), int(slot["ids"]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's key, the number of ids before it, and its ids.

        Place and length are what the index has for the key; only documents
        without a key, and those that share one, take theirs from the row table.
        """
        rows = np.frombuffer(self._read(_ROW.itemsize * self.n, self._rows), _ROW, self.n)
        ids = rows["ids"].copy()
        firsts = np.cumsum(ids, dtype=np.uint64) - ids
        real = np.flatnonzero(rows["key"] != _NULL)
        keys, at, times = np.unique(rows["key"][real], return_index=True, return_counts=True)
        index = np.frombuffer(self._read(_BLOCK.itemsize * sum(self.sizes), self._index), _BLOCK)
        firsts_of = np.cumsum([0, *self.sizes])
        where = slots_of(self.sizes, lambda level, number: index[firsts_of[level] + number], keys)
        slots = np.frombuffer(self._read(_SLOT.itemsize * self.keys, self._slots), _SLOT, self.keys)
        if len(keys) != self.keys or (where < 0).any() or (where >= self.keys).any() or (slots["print"][where] != _mix(keys, 99) >> np.uint64(32)).any() or (slots["rows"][where] != times).any():
            raise ValueError("the shard's index doesn't hold the keys of its rows")
        single = times == 1
        firsts[real[at[single]]], ids[real[at[single]]] = slots["first"][where[single]], slots["ids"][where[single]]
        for key, first, n in zip(rows["key"].tolist(), firsts.tolist(), ids.tolist(), strict=True):
            yield (None if key == _NULL else key), first, self._take(first, n)


def opened(path: str) -> Shard:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    file = store.open_input_file(inner)
    return Shard(lambda n, at: file.read_at(n, at))


def _put(path: str, raw: bytes) -> None:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner, compression=None) as f:
        f.write(raw)


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None, shard_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents; returns the manifest, a row for each shard in key order by ``part, seq``."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = word_bpe(vocabulary), TaskContext.get().partitionId()
        stored = encoder.stored if end_id < 1 << 16 else np.dtype("<u4")
        keys, ids, size, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{path}/ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.bin"
            _put(name, shard_bytes(keys, ids, stored.itemsize))
            row = [part, seq, name, next((k for k in keys if k is not None), None), keys[-1], len(keys), size]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4], strict=True)], ["part", "seq", "path", "first_key", "last_key", "documents", "ids"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encoder.encode(text.as_py())
                if keys and size + len(found) + 1 > shard_ids:
                    yield flush()
                    keys, ids, size, seq = [], [], 0, seq + 1
                keys.append(key)
                ids.append(np.append(found, np.uint32(end_id)).astype(stored))
                size += len(found) + 1
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), whole(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one key may lie in several parts, in the order of a hash of their text.
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ordered.select("key", "text").mapInArrow(shards, MANIFEST), "token-manifest")


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``: the number of ids in all shards before each.

    Sums go over the parts first: the one window over all has a row for each
    part, not for each shard.
    """
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_ids"))
    before = F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("_in", within).join(parts.select("part", before.alias("_before")), "part").select(*manifest.columns, (F.col("_before") + F.col("_in")).alias("first"))


READ = "key long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the manifest's files, found by the shards' indexes: its key, the number of ids before it, its own, and their crc32.

    The crc is of the ids as little-endian unsigned 32-bit integers.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for key, first, ids in opened(path).documents():
                    out.append((key, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return located(manifest).select("path", "first").repartition(n, "path").mapInArrow(rows, READ)


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """``key, ids`` for each of ``keys`` that the files hold, by the shards' hash indexes; ids of all rows of the key, in the files' order."""
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).distinct()
    at = manifest.select("path", "part", "seq", "first_key", "last_key")
    asked = wanted.join(at, F.col("key").between(F.col("first_key"), F.col("last_key"))).select("path", "part", "seq", "key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = shard = None
        for batch in batches:
            got: list[list] = [[], [], [], []]
            for wanted_path, part, seq, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wanted_path != path:
                    path, shard = wanted_path, opened(wanted_path)
                try:
                    value = (key, part, seq, shard[key].tolist())
                except KeyError:
                    continue
                for column, x in zip(got, value, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())], strict=True)], ["key", "part", "seq", "ids"])

    # Keys of a shard come one after another, so it is opened once.
    found = asked.repartition("path").sortWithinPartitions("path", "key").mapInArrow(find, "key long, part int, seq int, ids array<long>")
    return found.groupBy("key").agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "seq", "ids")))["ids"]).alias("ids"))
