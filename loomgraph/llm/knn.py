"""Exact top-k by inner product: a Voronoi kNN join.

The largest inner products are the smallest distances once each vector x gets
one more component, sqrt(M^2 - |x|^2), and each query a zero there (M: the
largest norm), so bounds of a metric space apply.  Candidates and queries fall
into the cells of a bounded number of pivots.  Small summaries of the cells
(radius, the k + 1 distances nearest the pivot) give each query cell a
distance within which its k best certainly lie; a candidate is replicated only
to groups of query cells that it may reach within that distance.  Each group
is solved in blocks of candidates by matrix products, and the blocks' best are
merged.

Among equal vectors only the k + 1 smallest ids can ever be among the best, so
the rest of them drop out beforehand, inside the map tasks.

Components are floor(scale * x), so scores are whole numbers and exact.
Defined results: null vectors and vectors with null or non-finite components
take no part; shorter vectors count as padded with zeros; repeated rows (same
id, same vector) are one row; rows that share an id are never each other's
candidates; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RESULT = "query_id long, vec_id long, score long"


def whole_numbers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null unless all components are finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(fit, F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), dim)


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (x, extra) from the pivots, whose last component is the additional one."""
    full = np.column_stack([x, extra])
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 64, group_queries: int = 4096, block: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds, against all rows.

    ``pivots``: at most so many cells.  ``group_queries`` and ``block``: about so
    many queries and candidates meet in one matrix product.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("q"), whole_numbers(F.col(vector_col), scale).alias("v")).filter("v IS NOT NULL AND vec_id IS NOT NULL").distinct()
    rows = written(rows.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)), "vectors")
    size = rows.agg(F.max(F.size("v")), F.max("norm"), F.count("*"), F.count_if("q")).first()
    spark = rows.sparkSession
    if not size[2] or not size[3]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, most, n, _ = size
    if most >= 1 << 52:
        raise ValueError("components are too large for exact products; choose a smaller scale")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(2).to_pylist():
                x = np.zeros(dim, "<f8")
                x[: len(v)] = v
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "q", "x"])

    flat = rows.select("vec_id", F.coalesce("q", F.lit(False)).alias("q"), "v").mapInArrow(packed, "vec_id long, q boolean, x binary")
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    candidates = flat.withColumn("r", rank).filter(F.col("r") <= k + 1).select("vec_id", "x")

    # The pivots: candidates of the smallest hashes, a bounded number of rows.
    chosen = [r.x for r in candidates.select("x", F.xxhash64("x").alias("h")).distinct().orderBy("h", "x").limit(pivots).collect()]
    top = float(most)
    at = _matrix(chosen, dim)
    at = np.column_stack([at, np.sqrt(np.maximum(top - (at**2).sum(1), 0))])

    def cells(queries: bool):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1).to_pylist(), dim)
                extra = np.zeros(len(x)) if queries else np.sqrt(np.maximum(top - (x**2).sum(1), 0))
                away = _distances(x, extra, at)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])], ["vec_id", "x", "cell", "away"])

        return assign

    with_cell = "vec_id long, x binary, cell int, away double"
    slots = max(1, -(-n // block))
    slot = F.pmod(F.xxhash64("vec_id", "x"), F.lit(slots)).cast("int")
    data = written(candidates.mapInArrow(cells(False), with_cell).withColumn("slot", slot), "candidates")
    asked = written(flat.filter("q").select("vec_id", "x").mapInArrow(cells(True), with_cell), "queries")

    # Summaries: at most pivots * (k + 1) and pivots rows.
    nearest = F.row_number().over(Window.partitionBy("cell").orderBy("away"))
    near = data.select("cell", "away", nearest.alias("r")).filter(F.col("r") <= k + 1).collect()
    radius = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect()}
    between = np.sqrt(((at[:, None, :] - at[None, :, :]) ** 2).sum(2))
    near_cell, near_away = np.array([r.cell for r in near]), np.array([r.away for r in near])

    # Query cells in groups of about group_queries queries; larger cells are split by a hash of the id.
    groups: dict[int, tuple[int, int]] = {}
    first, filled = 0, 0
    for cell, (_, count) in sorted(radius.items()):
        if filled and filled + count > group_queries:
            first, filled = first + 1, 0
        parts = -(-count // group_queries)
        groups[cell] = (first, parts)
        filled += count
        if parts > 1:
            first, filled = first + parts, 0
    reach = {}
    for cell, (far, _) in radius.items():
        bound = np.sort(far + between[cell][near_cell] + near_away)
        reach[cell] = (bound[k] if len(bound) > k else np.inf, far)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            need: dict[int, np.ndarray] = {}
            for query_cell, (bound, far) in reach.items():
                # |q, x| >= | |p, x's pivot| - |x, x's pivot| | - |q, p|
                least = np.abs(between[query_cell][cell] - away) - far
                hit = least <= bound + 1e-6 * (1 + top)
                first, parts = groups[query_cell]
                for g in range(first, first + parts):
                    need[g] = need.get(g, False) | hit
            for g, hit in need.items():
                some = batch.filter(pa.array(hit))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, g, np.int32)), some.column(4), some.column(0), some.column(1)], ["g", "slot", "vec_id", "x"])

    sent = data.mapInArrow(replicate, "g int, slot int, vec_id long, x binary")
    of = F.create_map(*[F.lit(v) for cell, (g, _) in groups.items() for v in (cell, g)])
    split = F.create_map(*[F.lit(v) for cell, (_, parts) in groups.items() for v in (cell, parts)])
    placed = asked.withColumn("g", (of[F.col("cell")] + F.pmod(F.xxhash64("vec_id"), split[F.col("cell")])).cast("int"))
    placed = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).select("g", "slot", "vec_id", "x")

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, q_ids = _matrix(list(queries.x), dim), queries.vec_id.to_numpy()
        data = data.sort_values("vec_id")
        x, ids = _matrix(list(data.x), dim), data.vec_id.to_numpy()
        out = []
        for a in range(0, len(q), 256):
            scores = q[a : a + 256] @ x.T
            scores[q_ids[a : a + 256, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                # Whatever reaches the k-th score; equal ones are told apart by id below.
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                which, col = np.nonzero(scores >= least[:, None])
            else:
                which, col = np.nonzero(np.isfinite(scores))
            found = scores[which, col]
            keep = np.isfinite(found)
            which, col, found = which[keep], col[keep], found[keep]
            order = np.lexsort((ids[col], -found, which))
            which, col, found = which[order], col[order], found[order]
            place = np.arange(len(which)) - np.searchsorted(which, which)
            out.append(pd.DataFrame({"query_id": q_ids[a + which], "vec_id": ids[col], "score": found.astype(np.int64)})[place < k])
        return pd.concat(out)

    best = placed.groupBy("g", "slot").cogroup(sent.groupBy("g", "slot")).applyInPandas(lambda q, d: solve(q, d), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
