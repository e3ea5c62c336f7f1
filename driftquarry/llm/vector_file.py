"""Exact top-k search with a vector-approximation file.

Each dimension's range is cut into 256 equal intervals; a vector's approximation is its cell, one byte a
dimension, kept with the distance r from the cell's centre c. By the triangle inequality the distance of a query q
lies in [|q-c| - r, |q-c| + r], so scanning approximations bounds all distances without reading vectors. Then

1. scan: blocks of queries meet parts of the file; per query and part, the entries whose lower bound does not
   exceed the part's kth upper bound remain,
2. over all parts, those whose lower bound exceeds the query's kth smallest upper bound go,
3. read: the exact vectors of what remains are read in order of lower bound, in batches that grow fourfold, until
   the next lower bound exceeds the kth exact distance: the kth result is certain then. Queries that are certain
   take no part in later batches.

Bounds hold whatever the magnitudes: vectors are moved to the middle of the ranges first, and what rounding can
do to a distance from a matrix product is taken off the lower and added to the upper bound, in proportion to the
squared lengths that enter it. Exact distances are those of the vectors as they are, difference by difference.

The queries are stated (in `op7_top_k` every row whose id is divisible by 20) and each is held against all
rows, in blocks; memory is bounded by a block and a part. What is shuffled for the scan is a quarter or an eighth of
what vectors would take.

Defined cases. Distances are Euclidean, in double precision. Vectors that are null, empty, hold nulls or
non-finite values, or are of another length than the longest, and rows with a null id, are neither queries nor
results; nor are vectors with a value above 1e150, whose distances double precision can't hold. Repeated rows are
one vector; of several vectors of one id the smallest (as an array) counts. Ties are in order of the id. A query has
fewer than k results if there are fewer other vectors. Further columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed

K = 10
#: Vectors of a block; blocks of the file that a block of queries meets at once; growth of the batches that are read.
BLOCK, PART, GROWTH = 4096, 16, 4
CELLS = 256


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1)


def _approximate(table: pa.Table, low: np.ndarray, step: np.ndarray) -> pa.Table:
    """One block: ids, cells and distances from cell centres, packed."""
    order = np.argsort(np.asarray(table.column("id")))
    ids, x = np.asarray(table.column("id"))[order], _matrix(table.column("v"))[order]
    cells = np.clip(np.floor((x - low) / step), 0, CELLS - 1).astype(np.uint8)
    # The centre as the scan computes it; what rounding adds is far below the margin.
    radius = np.sqrt(((x - (low + (cells + 0.5) * step)) ** 2).sum(1)) * (1 + 1e-12)
    return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary()), "radius": pa.array([radius.tobytes()], pa.binary())})


def _asked(table: pa.Table) -> pa.Table:
    """One block of queries: ids and vectors, packed."""
    order = np.argsort(np.asarray(table.column("id")))
    ids, x = np.asarray(table.column("id"))[order], _matrix(table.column("v"))[order]
    return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary())})


def distance_bounds(q: np.ndarray, cells: np.ndarray, radius: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the distances of queries from the vectors behind the cells."""
    middle = low + CELLS / 2 * step
    c = (cells + (0.5 - CELLS / 2)) * step
    q = q - middle
    qn, cn = (q**2).sum(1)[:, None], (c**2).sum(1)
    d2 = qn + cn - 2 * (q @ c.T)
    # A sum of n products is off by n roundings of their absolute sum at most, which is below (|q|^2 + |c|^2) / 2;
    # moving q and the centre costs a rounding of each coordinate, in units of the middle's and the range's size.
    eps, n = np.finfo(np.float64).eps, q.shape[1]
    off = 4 * (n + 4) * eps * (qn + cn)
    moved = 4 * eps * np.sqrt(((np.abs(low) + CELLS * step) ** 2).sum())
    lower = np.sqrt(np.maximum(d2 - off, 0)) - radius - moved
    upper = np.sqrt(np.maximum(d2, 0) + off) + radius + moved
    return np.maximum(lower * (1 - 1e-12), 0), upper * (1 + 1e-12)


def _scan(table: pa.Table, low: np.ndarray, step: np.ndarray, k: int) -> pa.Table:
    """One block of queries against some blocks of approximations: bounds of all pairs, and the entries that may be among the k nearest of these blocks."""
    rows = table.to_pylist()
    query = next(r for r in rows if r["vectors"] is not None)
    q_ids = np.frombuffer(query["ids"], np.int64)
    q, file = np.frombuffer(query["vectors"], np.float64).reshape(len(q_ids), -1), []
    for row in sorted((r for r in rows if r["vectors"] is None), key=lambda r: r["block"]):
        ids = np.frombuffer(row["ids"], np.int64)
        file.append((ids, np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["radius"], np.float64)))
    found = [[np.zeros(0, t)] for t in (np.int64, np.int64, float, float)]
    bounds = np.full((len(q_ids), k), np.inf)  # the k smallest upper bounds so far
    for ids, cells, r in file:
        for start in range(0, len(q_ids), 256):
            part = slice(start, start + 256)
            lower, upper = distance_bounds(q[part], cells, r, low, step)
            own = q_ids[part, None] == ids
            upper[own] = np.inf
            least = np.partition(upper, k - 1, axis=1)[:, :k] if upper.shape[1] > k else upper
            bounds[part] = np.sort(np.concatenate([bounds[part], least], axis=1), axis=1)[:, :k]
            i, j = np.nonzero((lower <= bounds[part, -1:]) & ~own)
            for out, x in zip(found, (start + i, ids[j], lower[i, j], upper[i, j])):
                out.append(x)
    i, c_ids, lo, up = (np.concatenate(x) for x in found)
    kept = lo <= bounds[i, -1]
    return pa.table({"q": q_ids[i[kept]], "c": c_ids[kept], "lower": lo[kept], "upper": up[kept]})


def _distances(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact distances of pairs (q, c)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(((_matrix(batch.column("qv")) - _matrix(batch.column("cv"))) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("c"), pa.array(d)], names=["q", "c", "distance"])

    both = pairs.join(vectors.select(F.col("id").alias("c"), F.col("v").alias("cv")), "c").join(vectors.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    return both.select("q", "c", "qv", "cv").mapInArrow(run, "q long, c long, distance double")


def _read(candidates: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, c, distance) of the k nearest candidates of each query, read in order of lower bound until no more are needed. candidates: (q, c, lower, place)."""
    nearest, done, take = None, 0, k
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "c"))
    while True:
        batch = candidates.where((F.col("place") > done) & (F.col("place") <= take))
        if nearest is not None:
            # Queries with k results look only at lower bounds up to the kth distance; its last bits are allowed for.
            kth = nearest.groupBy("q").agg(F.max("distance").alias("kth"))
            batch = batch.join(kth, "q").where(F.col("lower") <= F.col("kth") * (1 + 1e-12)).drop("kth")
            batch = checkpointed(batch)
            if batch.isEmpty():
                return nearest
        exact = _distances(batch.select("q", "c"), vectors)
        exact = exact if nearest is None else exact.unionByName(nearest)
        nearest = checkpointed(exact.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        done, take = take, take + (take - done) * GROWTH


def top_k(table: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(id, rank, neighbor_id, distance): the k nearest other vectors, from rank 1, of each vector whose row meets `queries` (default: of every vector)."""
    bound_batches(table.sparkSession)
    v = F.col(f"`{vector_col}`")
    if dict(table.dtypes)[vector_col] != "array<float>":  # single precision travels as it is
        v = v.cast("array<double>")
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    clean = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), asked.alias("asked")).where("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= 1e150)")
    clean = checkpointed(clean.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked")))
    n, dim = clean.agg(F.count("*"), F.max(F.size("v"))).first()
    names = f"{id_col} long, rank int, neighbor_id long, distance double"
    if not n or n < 2:
        return table.sparkSession.createDataFrame([], names)
    clean = clean.where(F.size("v") == dim)

    def ends(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(x.min(0)), pa.array(x.max(0))], names=["i", "low", "high"])

    found = sorted(tuple(r) for r in clean.mapInArrow(ends, "i int, low double, high double").groupBy("i").agg(F.min("low"), F.max("high")).collect())
    low = np.array([r[1] for r in found])
    step = np.maximum(np.array([r[2] for r in found]) - low, 1e-300) / CELLS

    blocks = -(-n // BLOCK)
    questions = clean.where("asked")
    q_blocks = max(1, -(-questions.count() // BLOCK))
    in_block = lambda b: F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")
    file = checkpointed(clean.select("id", "v", in_block(blocks).alias("block")).groupBy("block").applyInArrow(lambda t: _approximate(t, low, step), "block int, ids binary, cells binary, radius binary"))
    asking = checkpointed(questions.select("id", "v", in_block(q_blocks).alias("block")).groupBy("block").applyInArrow(_asked, "block int, ids binary, vectors binary"))
    # A block of queries travels as vectors, once for each part of the file; what it is held against as approximations.
    parts = -(-blocks // PART)
    nothing = F.lit(None).cast("binary")
    against = file.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), F.expr(f"block div {PART}").cast("int").alias("part"), "block", "ids", "cells", "radius", nothing.alias("vectors"))
    held = asking.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", "ids", nothing.alias("cells"), nothing.alias("radius"), "vectors")
    meets = held.unionByName(against).groupBy("qb", "part")
    bounds = meets.applyInArrow(lambda t: _scan(t, low, step, k) if _both(t) else _scan_nothing(), "q long, c long, lower double, upper double")
    limit = F.max(F.when(F.col("place") <= k, F.col("upper"))).over(W.partitionBy("q"))
    kept = bounds.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("upper", "c"))).withColumn("limit", limit).where("lower <= limit")
    kept = checkpointed(kept.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("lower", "c"))).select("q", "c", "lower", "place"))
    nearest = _read(kept, clean, k)
    ranked = nearest.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "c")))
    return ranked.select(F.col("q").alias(id_col), "rank", F.col("c").alias("neighbor_id"), F.round("distance", 6).alias("distance"))


def _both(table: pa.Table) -> bool:
    """Whether queries and file meet here: hashing may leave a block empty."""
    return 0 < table.column("vectors").null_count < table.num_rows


def _scan_nothing() -> pa.Table:
    return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "lower": pa.array([], pa.float64()), "upper": pa.array([], pa.float64())})
