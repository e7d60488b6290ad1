"""N-gram Jaccard join with prefix, length, positional and suffix filters.

A text's words are its runs of characters other than ASCII white space,
A-Z lower-cased; its set holds its distinct n-word shingles (with fewer words,
the whole sequence as one; without words, none).  Two texts link when
``100 * intersection >= percent * union``.

1. Every shingle is counted exactly.  Documents are taken in small blocks; a
   block asks, for each of its shingles, the bucket of the shingle's hash how
   many sets hold it.  Texts of one word sequence are one set of a block.  A
   shingle that a block holds several times is asked for once, so a shingle
   that a third of all documents share costs a bucket one entry for each block.
   Only shingles of two sets or more are answered.
2. Shingles that are nobody else's can't be shared, so a set goes on only if
   the others reach the overlap that the smallest partner needs; all later
   steps work on these sets and these shingles alone, and no text is read again.
3. A set's order is rare first: those of its own, then by count and hash.  Two
   sets that link share a shingle among the first few of each (the prefixes),
   so only these are joined.  Lengths, places, and the shingles behind the
   first shared place, counted by parts of the hash range (the suffix filter),
   turn down pairs that can't reach the bound.
4. A pair that is left is verified once, by its whole sets of shared shingles.

No group emits all its pairs: the sets of a shingle meet a head, the one with
the fewest shingles of its own, and links join classes.  Later rounds go on
with the sets that, by lengths and places, may still link with one of another
class that shares their shingle: members of the classes but the shingle's
largest are the next heads, some a round, until none is left.  So the classes
are those of all links, and a group of copies costs a few rows for each member.
Sets of a shingle are spread by a salt that follows its count, so a hot one
fills no single task.

Shingles are compared by hashes of 48 bits and those of the bucket's number.
A block is told by its partition and its place there, so ``docs`` should be a
table read from storage, whose tasks, when lost, read the same rows again.

Defined results: a null text is the empty text, which links with nothing; rows
with null ids take no part; rows that share an id are one document that links
by any of its texts, so an id has one class; repeated rows all count; an empty
table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, whole, with_group, written

#: Sets and shingles of a block at most (a set's number there takes one byte; a longer text is a block of its own).
BLOCK_SETS, BLOCK_SHINGLES = 255, 1 << 21
#: About so many shingles in a bucket.
BUCKET_SHINGLES = 1_500_000
#: Parts of the hash range for the suffix filter, a power of two.
PARTS = 64
#: Sets of a hot shingle for each salt, about.
SALTED = 512
_SEED = np.uint64(0x9E3779B97F4A7C15)  # odd
_REPEATED = 255


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, by whole-array operations on a text's bytes."""

    _BLANK = np.zeros(256, bool)
    _BLANK[[32, *range(9, 14)]] = True
    _LETTER = _stirred(np.arange(1, 257, dtype=np.uint64) * _SEED)

    def __init__(self, n: int):
        self.n, self.powers = n, np.ones(1, np.uint64)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word: its bytes' random values times powers by their place in the word, summed."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # of bytes: only A-Z
        blank = self._BLANK[data]
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        length = edges[1::2] - edges[0::2]
        if not len(length):
            return np.empty(0, np.uint64)
        start = np.cumsum(length) - length
        longest = int(length.max())
        with np.errstate(over="ignore"):
            if longest > len(self.powers):
                self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * longest, _SEED)]), dtype=np.uint64)
            letters = data[~blank]
            place = np.arange(len(letters)) - np.repeat(start, length)
            sums = np.add.reduceat(self._LETTER[letters] * self.powers[place], start)
            return _stirred(sums + length.astype(np.uint64))

    def set(self, text: str) -> tuple[np.ndarray, bytes]:
        """The sorted distinct hashes of the shingles, and a 128-bit hash of the word sequence (empty without words)."""
        w = self.words(text)
        if not len(w):
            return w, b""
        sequence = xxhash.xxh3_128_digest(w.tobytes())
        n = min(self.n, len(w))
        with np.errstate(over="ignore"):
            # Each place of a shingle has an odd factor of its own, so order counts.
            h = w[: len(w) - n + 1] * _SEED
            factor = _SEED
            for i in range(1, n):
                factor = (factor * _SEED) ^ np.uint64(2 * i)
                h += w[i : len(w) - n + 1 + i] * factor
            h = _stirred(h + np.uint64(n))
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))], sequence


def least_overlap(n: int, percent: int) -> int:
    """So many shingles a set of ``n`` shares with any linked one, at least."""
    return -(-percent * n // 100)


def linked(both: int, a: int, b: int, percent: int) -> bool:
    """Whether two sets of sizes ``a`` and ``b`` that share ``both`` shingles link."""
    return both > 0 and 100 * both >= percent * (a + b - both)


_ASKED = "bucket long, block long, hashes binary, owners binary, times binary, ids binary, who binary, sequences binary, sizes binary"
_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 7]


def _batch(columns: list[list], types: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in names.split(", ")])


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each of ``x``."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _keys(hashes: np.ndarray, bucket: int | np.ndarray) -> np.ndarray:
    """The number that tells a shingle: 48 bits of its hash and 16 of its bucket."""
    return (hashes << np.uint64(16)) | (np.asarray(bucket).astype(np.uint64) & np.uint64(0xFFFF))


class _Block:
    """Documents whose shingles are asked for together."""

    def __init__(self):
        self.ids: list[int] = []
        self.who: list[int] = []  # each document's set, 255: none
        self.sets: list[np.ndarray] = []
        self.numbers: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc: int, shingles: np.ndarray, sequence: bytes) -> None:
        if sequence and sequence not in self.numbers:
            self.numbers[sequence] = len(self.sets)
            self.sets.append(shingles)
            self.size += len(shingles)
        self.ids.append(doc)
        self.who.append(self.numbers.get(sequence, _REPEATED))

    def asked(self, block: int, buckets: int) -> pa.RecordBatch:
        """A row for each bucket, and one, with a bucket of its own below zero, of the documents and of the shingles held several times."""
        sizes = np.array([len(s) for s in self.sets], "<u4")
        h = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint8), sizes)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
        times = np.diff(np.append(first, len(h)))
        bucket = (((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)  # ascends with the hash
        again = np.repeat(times, times) > 1
        out: list[list] = [[-1 - block], [block], [_keys(h[again], bucket[again]).astype("<u8").tobytes()], [owner[again].tobytes()], [b""], [np.array(self.ids, "<i8").tobytes()], [bytes(self.who)], [b"".join(self.numbers)], [sizes.tobytes()]]
        hashes = _six(h[first])
        owners = np.where(times > 1, np.uint8(_REPEATED), owner[first]).astype(np.uint8).tobytes()
        counts = times.astype(np.uint8).tobytes()
        of = bucket[first]
        edges = [*np.flatnonzero(np.diff(of, prepend=-1)), len(of)]
        for a, b in zip(edges, edges[1:], strict=False):
            for column, value in zip(out, (int(of[a]), block, hashes[6 * a : 6 * b], owners[a:b], counts[a:b], b"", b"", b"", b""), strict=True):
                column.append(value)
        return _batch(out, _TYPES, _ASKED)


def _asked(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, block, number = Shingler(n), _Block(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc, *shingler.set(text.as_py()))
                if len(block.sets) == BLOCK_SETS or block.size >= BLOCK_SHINGLES or len(block.ids) == 64 * BLOCK_SETS:
                    yield block.asked(number, buckets)
                    block, number = _Block(), number + 1
        if block.ids:
            yield block.asked(number, buckets)

    return texts.select("doc_id", "text").mapInArrow(ask, _ASKED)


_ANSWERED = "bucket long, block long, hashes binary, owners binary, counts binary, ids binary, who binary, sequences binary, sizes binary"


def _answered(asked: DataFrame) -> DataFrame:
    """For each block and bucket the shingles that two sets or more hold, with the number of sets."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, hashes, owners, times = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if not blocks:
                return
            h = _from_six(b"".join(hashes))
            _, at = np.unique(h, return_inverse=True)
            count = np.bincount(at, weights=np.frombuffer(b"".join(times), np.uint8))[at]
            found = np.flatnonzero(count > 1)
            ends = np.searchsorted(found, np.cumsum([len(x) for x in owners]))
            got, own = _six(h[found]), np.frombuffer(b"".join(owners), np.uint8)[found].tobytes()
            counts = np.minimum(count[found], 65535).astype("<u2").tobytes()
            out: list[list] = [[] for _ in _TYPES]
            for block, a, b in zip(blocks, [0, *ends[:-1]], ends, strict=True):
                if a < b:
                    for column, value in zip(out, (bucket, block, got[6 * a : 6 * b], own[a:b], counts[2 * a : 2 * b], b"", b"", b"", b""), strict=True):
                        column.append(value)
            yield _batch(out, _TYPES, _ANSWERED)

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            about = [i for i, b in enumerate(numbers) if b < 0]
            if about:
                yield pa.RecordBatch.from_arrays(batch.take(pa.array(about)).columns, [x.split()[0] for x in _ANSWERED.split(", ")])
            for i, b in enumerate(numbers):
                if b >= 0:
                    if b != bucket:
                        yield from close()
                        bucket, blocks, hashes, owners, times = b, [], [], [], []
                    blocks.append(batch.column(1)[i].as_py())
                    for kept, column in ((hashes, 2), (owners, 3), (times, 4)):
                        kept.append(batch.column(column)[i].as_py())
        yield from close()

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, _ANSWERED)


_RECORD = "doc_id long, sequence binary, n int, keys binary, often binary"


def _records(answered: DataFrame, percent: int) -> DataFrame:
    """Each document's sequence hash and set size; and for sets that may link the shared shingles, rare first, with the counts of those in the prefix."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            (about,) = (r for r in rows if r[0] < 0)
            others = [r for r in rows if r[0] >= 0]
            key = np.concatenate([*(_keys(_from_six(r[1]), r[0]) for r in others), np.empty(0, np.uint64)])
            owner = np.frombuffer(b"".join(r[2] for r in others), np.uint8)
            count = np.frombuffer(b"".join(r[3] for r in others), "<u2")
            # Shingles that several sets of the block hold: all of them were answered, once each.
            many, whose = np.frombuffer(about[1], "<u8"), np.frombuffer(about[2], np.uint8)
            several = owner == _REPEATED
            by = np.argsort(key[several])
            known, told = key[several][by], count[several][by]
            key = np.concatenate([key[~several], many])
            count = np.concatenate([count[~several], told[np.searchsorted(known, many)] if len(many) else np.empty(0, "<u2")])
            owner = np.concatenate([owner[~several], whose])
            order = np.lexsort((key, count, owner))
            key, count, owner = key[order], count[order], owner[order]
            ids, who, sizes = np.frombuffer(about[4], "<i8").tolist(), about[5], np.frombuffer(about[7], "<u4").tolist()
            edges = np.searchsorted(owner, np.arange(len(sizes) + 1))
            leader: dict[int, int] = {}
            for doc, w in zip(ids, who, strict=True):
                leader[w] = min(doc, leader.get(w, doc))
            out: list[list] = [[], [], [], [], []]
            for doc, w in zip(ids, who, strict=True):
                value = (doc, b"", 0, None, None)
                if w != _REPEATED:
                    a, b, n = int(edges[w]), int(edges[w + 1]), sizes[w]
                    spare = b - a - least_overlap(n, percent)
                    value = (doc, about[6][16 * w : 16 * w + 16], n, None, None)
                    if spare >= 0 and leader.get(w) == doc:  # once for each set of the block
                        del leader[w]
                        value = (*value[:3], key[a:b].astype("<u8").tobytes(), count[a : a + spare + 1].astype("<u2").tobytes())
                for column, x in zip(out, value, strict=True):
                    column.append(x)
            yield _batch(out, [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()], _RECORD)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if row[1] != block:
                    yield from close()
                    block, rows = row[1], []
                rows.append((row[0], *row[2:]))
        yield from close()

    return answered.repartition("block").sortWithinPartitions("block").mapInArrow(gather, _RECORD)


_POSTING = "shingle long, salt int, salts int, seq binary, id long, n int, u int, pos int"


def _postings(sets: DataFrame) -> DataFrame:
    """A row for each shared shingle of each prefix, with its place in the set's order; ``u``: how many shingles are the set's own."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) // 2 for x in batch.column(4).to_pylist()]
            if not sum(sizes):
                continue
            keys = np.concatenate([np.frombuffer(k, "<i8", m) for k, m in zip(batch.column(3).to_pylist(), sizes, strict=True)])
            often = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u2").astype(np.int32)
            own = np.array([n - len(k) // 8 for n, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.int32)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            salts = 1 + often // SALTED
            salt = np.array([xxhash.xxh3_64_intdigest(s) & 0x7FFFFFFF for s in batch.column(0).to_pylist()])[row] % salts
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(salt.astype(np.int32)), pa.array(salts), batch.column(0).take(of), batch.column(1).take(of), batch.column(2).take(of), pa.array(own[row]), pa.array((own[row] + place).astype(np.int32))], [x.split()[0] for x in _POSTING.split(", ")])

    return sets.select("seq", "id", "n", "keys", "often").mapInArrow(post, _POSTING)


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the smallest id that links reach from each id in ``links``; ids without links are left out.

    Each round every node takes the smallest label next to it and its label's
    own label, so chains shorten by half; a round is a written table.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct()
    edges = written(both, "links")
    table = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "id"), "labels")
    while True:
        labels = table.select("id", "label")
        # The smallest label among neighbours; hot nodes are pre-aggregated before the shuffle.
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("u")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Labels of labels, aggregated by label first so that one label's rows needn't meet.
        step = written(step, "labels-step")
        up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        further = written(step.join(up, "label", "left").select("id", "old", F.coalesce("up", "label").alias("label")), "labels")
        moved = further.filter("label <> old").limit(1).count()
        discard(table, step)
        if not moved:
            discard(edges)
            return further.select("id", "label")
        table = further


def _fits(percent: int) -> Column:
    """Length and positional filters of two sets, of sizes na and nb, that share the shingles at places pa and pb.

    A linked pair passes where its first shared shingle is looked at: before
    it nothing is shared, so the two share at most it and what lies behind it.
    Elsewhere the pair may be turned down.
    """
    lengths = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return lengths & (most * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb")))


def _side(df: DataFrame, k: str, *more: str) -> DataFrame:
    return df.select("shingle", "salt", F.struct("u", "seq").alias(k), F.col("n").alias(f"n{k}"), F.col("pos").alias(f"p{k}"), *[F.col(c).alias(f"{c}_{k}") for c in more])


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs, each once, of sets that met: ``a, b`` (the one with fewer shingles of its own), with sizes, and places of the first shingle at which they met."""
    up = F.col("a") > F.col("b")
    both = lambda x: [F.when(up, F.col(f"{x}{p}")).otherwise(F.col(f"{x}{q}")).alias(f"{x}{p}") for p, q in ("ab", "ba")]
    pairs = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), *both("n"), *both("p"))
    return pairs.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("na", "nb", "pa", "pb")]).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), "na", "nb", "pa", "pb", F.col("a.u").alias("ua"), F.col("b.u").alias("ub"))


def _suffix_filter(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that may reach the bound by the shingles behind the first shared place, counted by parts of the hash range."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, pa_, pb, ua, ub = (batch.column(i).to_numpy() for i in range(2, 8))
            fine = []
            for i, (ha, fa, hb, fb) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(8, 12)), strict=True)):
                rest = [np.frombuffer(h, "<u4") - np.bincount(np.frombuffer(f, np.uint8, p - u + 1), minlength=PARTS) for h, f, p, u in ((ha, fa, pa_[i], ua[i]), (hb, fb, pb[i], ub[i]))]
                most = 1 + int(np.minimum(*rest).sum())
                fine.append(most * (100 + percent) >= percent * (int(na[i]) + int(nb[i])))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(fine, pa.bool_()))

    of = lambda k: sketches.select(F.col("seq").alias(k), F.col("parts").alias(f"parts_{k}"), F.col("front").alias(f"front_{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "pa", "pb", "ua", "ub", "parts_a", "front_a", "parts_b", "front_b")
    return both.mapInArrow(check, "a binary, b binary, na int, nb int")


def _sketches(sets: DataFrame) -> DataFrame:
    """``seq, parts, front``: how many shared shingles fall into each part of the hash range, and the parts of those in the prefix, in order."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, front = [], []
            for keys, often in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = (np.frombuffer(keys, "<u8") >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.uint8)
                parts.append(np.bincount(part, minlength=PARTS).astype("<u4").tobytes())
                front.append(part[: len(often) // 2].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary()), pa.array(front, pa.binary())], ["seq", "parts", "front"])

    return sets.select("seq", "keys", "often").mapInArrow(sketch, "seq binary, parts binary, front binary")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a: a set, b: its head), as ids ``a, b``.

    A set goes once to each head that it is held against, the head's own
    first; a head with very many partners is split over several places.
    """
    spread = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).cast("int").alias("places"))
    placed = pairs.join(spread, "b").withColumn("place", F.pmod(F.xxhash64("a"), F.col("places")).cast("int"))
    routes = placed.select(F.col("a").alias("seq"), F.col("b").alias("head"), "place", F.lit(1).alias("turn"))
    own = spread.select(F.col("b").alias("seq"), F.col("b").alias("head"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("turn"))
    sent = sets.select("seq", "id", "n", "keys").join(routes.unionByName(own), "seq").select("head", "place", "turn", "id", "n", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = mine = None
        for batch in batches:
            a, b = [], []
            for h, turn, doc, n, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(keys, "<u8")
                if turn == 0:
                    head, mine = h, (doc, n, own)
                elif head == h and linked(len(np.intersect1d(own, mine[2], assume_unique=True)), n, mine[1], percent):
                    a.append(doc)
                    b.append(mine[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = sent.repartition("head", "place").sortWithinPartitions("head", "place", "turn")
    return ordered.select("head", "turn", "id", "n", "keys").mapInArrow(compare, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` more: only the classes that they join are worked on."""
    of = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"l{k}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(between)
    moved = labels.join(merged.select(F.col("id").alias("label"), F.col("label").alias("up")), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
    return written(moved.unionByName(merged.join(labels, "id", "left_anti")), "labels")


def _salted(of_shingle: DataFrame) -> DataFrame:
    """A row for each salt of a shingle, so that its sets needn't meet in one task."""
    return of_shingle.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def _reach(percent: int) -> list[Column]:
    """``lo, hi``: the sizes that a partner of a set of size n may have if the first shingle they share is at the set's place ``pos`` (the two filters of ``_fits``, seen from one side)."""
    low = F.floor((F.lit(percent) * F.col("n") + 99) / 100).cast("int")
    high = F.least(F.floor(F.lit(100) * F.col("n") / percent), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n"))
    return [low.alias("lo"), high.cast("int").alias("hi")]


def _open(free: DataFrame) -> DataFrame:
    """Those rows of ``free`` that may still link with a set of another class that shares their shingle, with the shingle's largest class ``main``.

    The sets of a shingle are summed up by class and by steps of 2 % in size,
    so a summary's length is bounded by the number of steps, and a set is held
    against the summaries, not against the sets.
    """
    step = F.floor(F.log("n") / F.log(F.lit(1.02))).cast("int")
    spans = free.groupBy("shingle", step.alias("step")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"))
    spans = spans.groupBy("shingle").agg(F.collect_list(F.struct("least", "most", "lo", "hi", "first", "last")).alias("spans"), F.min("first").alias("first"), F.max("last").alias("last"))
    main = free.groupBy("shingle", "label").agg(F.count("*").alias("many"), F.max("salts").alias("salts")).groupBy("shingle").agg(F.max_by("label", "many").alias("main"), F.max("salts").alias("salts"))
    mixed = spans.filter("first < last").drop("first", "last").join(main, "shingle")
    there = free.drop("salts").join(_salted(mixed), ["shingle", "salt"])
    meets = F.exists("spans", lambda x: (x["least"] <= F.col("hi")) & (x["most"] >= F.col("lo")) & (x["lo"] <= F.col("n")) & (x["hi"] >= F.col("n")) & ((x["first"] != F.col("label")) | (x["last"] != F.col("label"))))
    return there.filter(meets).drop("spans")


def _labels(sets: DataFrame, known: DataFrame, percent: int, heads: int) -> DataFrame:
    """``id, label`` for each id that links, or that ``known`` links (a, b) name: the smallest id of its class."""
    sketches = written(_sketches(sets), "sketches")
    posted = _postings(sets)
    # The first head of a shingle: the set with the fewest shingles of its own.
    first = posted.groupBy("shingle").agg(F.count("*").alias("many"), F.max("salts").alias("salts"), F.min(F.struct("u", "seq")).alias("head")).filter("many > 1").drop("many")
    lists = written(posted.drop("salts").join(_salted(first), ["shingle", "salt"]).select("*", *_reach(percent)), "postings")
    is_head = F.struct("u", "seq") == F.col("head")
    used = lists.filter(is_head)
    hit = _side(lists.filter(~is_head), "a").join(_side(_salted(used.drop("salt")), "b"), ["shingle", "salt"]).filter(_fits(percent))
    tried = written(_suffix_filter(_candidates(hit), sketches, percent), "pairs")
    spent = [sketches, lists, tried]
    labels = components(_verified(sets, tried, percent).unionByName(known))
    # Those that weren't heads of the shingle yet, and may still link.
    free = lists.filter(~is_head).drop("head")

    while True:
        now = free.join(labels.withColumnRenamed("label", "known"), "id", "left").withColumn("label", F.coalesce("known", "id")).drop("known")
        free = written(_open(now), "open")
        spent.append(free)
        if free.limit(1).count() == 0:
            discard(*spent)
            return labels
        # The next heads: members of the classes but the shingle's largest; ranked by salt first, so no task has all sets of a shingle.
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("u", "seq"))
        some = free.filter("label <> main").withColumn("r", rank("shingle", "salt")).filter(F.col("r") <= heads)
        chosen = written(some.withColumn("r", rank("shingle")).filter(F.col("r") <= heads).drop("r", "salt"), "heads")
        differ = _fits(percent) & (F.col("label_a") != F.col("label_b"))
        hit = _side(free, "a", "label").join(_side(_salted(chosen), "b", "label"), ["shingle", "salt"]).filter(differ)
        fresh = written(_suffix_filter(_candidates(hit).join(tried.select("a", "b"), ["a", "b"], "left_anti"), sketches, percent), "pairs")
        spent += [chosen, fresh]
        free = free.join(chosen.select("shingle", "seq"), ["shingle", "seq"], "left_anti").drop("label", "main")
        if fresh.limit(1).count():
            tried = tried.unionByName(fresh)
            links = written(_verified(sets, fresh, percent), "verified")
            spent.append(links)
            if links.limit(1).count():
                labels = _joined(labels, links)


def link_classes(docs: DataFrame, n: int = 5, percent: int = 80, heads: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document: its set's size and the smallest id that links reach.

    ``heads``: so many sets of a shingle meet all its others in a round.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).filter("doc_id IS NOT NULL")
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), characters // (6 * BUCKET_SHINGLES))
    records = written(_records(_answered(_asked(texts, n, min(buckets, 1 << 24))), percent), "records")

    # One set for each word sequence, under the smallest id that has it.
    members = records.filter("n > 0").select("doc_id", "sequence", "n")
    first = members.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    members = written(with_group(members, first, ["sequence"], "copies").select("doc_id", "n", "rep"), "members")
    alive = records.filter("keys IS NOT NULL").groupBy("sequence").agg(F.min(F.struct("doc_id", "n", "keys", "often")).alias("s"))
    sets = written(alive.select(F.col("sequence").alias("seq"), F.col("s.doc_id").alias("id"), "s.n", "s.keys", "s.often"), "sets")
    # An id with several texts joins their classes.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).filter("b < most").select("doc_id", "b")
    known = members.join(several, "doc_id").select(F.col("rep").alias("a"), "b").filter("a <> b")
    known = written(known, "known")
    labels = _labels(sets, known, percent, heads)
    discard(sets, known)

    of = labels.select(F.col("id").alias("rep"), "label")
    full = members.join(of, "rep", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    empty = records.filter("n = 0").select("doc_id")
    other = full.join(empty.distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    alone = empty.join(other, "doc_id", "left").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("other", "doc_id").alias("component_id"))
    return full.unionByName(alone)
