"""Which worker owns a vertex: partitioners as columns, composable from the first to the last change of the cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_hash(v: Column) -> Column:
    """The usual 32-bit hash of a 64-bit integer: its two halves, one XOR the other, as a signed integer."""
    low = v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def string_hash(v: Column) -> Column:
    """The usual 31-based hash of a string of characters in the basic plane, as a signed 32-bit integer."""
    codes = F.transform(F.filter(F.split(v, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def by_hash(v: Column, workers: int, h: Column | None = None) -> Column:
    """The hash modulo the workers; never negative."""
    return F.pmod(long_hash(v) if h is None else h, F.lit(workers)).cast("int")


def naive(v: Column, before: Column, old: int, new: int, h: Column | None = None) -> Column:
    """After a change from ``old`` to ``new`` workers: the new bucket if that is a new worker or the cluster shrank, else the owner ``before``."""
    bucket = by_hash(v, new, h)
    return bucket if old > new else F.when(bucket >= old, bucket).otherwise(before)


def parts(share: float) -> int:
    """A worker that gives away ``share`` of its vertices gives those of one residue of so many."""
    return max(math.ceil(1.0 / share), 1)


def rehash(v: Column, before: Column, moves: dict[int, tuple[list[int], float, int]], h: Column | None = None) -> Column:
    """``moves``: worker -> (targets, share, residue); its vertices of that residue go to the targets by their hash."""
    h = long_hash(v) if h is None else h
    out = before
    for worker, (targets, share, residue) in sorted(moves.items()):
        to = F.lit(targets[0])
        for i, target in enumerate(targets[1:], 1):
            to = F.when(F.pmod(h, F.lit(len(targets))) == i, target).otherwise(to)
        out = F.when((before == worker) & (F.pmod(h, F.lit(parts(share))) == residue), to).otherwise(out)
    return out.cast("int")


def rehash_last(v: Column, before: Column, moves: dict[int, list[tuple[int, float]]], h: Column | None = None) -> Column:
    """As ``rehash`` with residue 0 and one target; of several for a worker, the last holds."""
    return rehash(v, before, {w: ([to[-1][0]], to[-1][1], 0) for w, to in moves.items() if to}, h)
