"""Shards in Hilbert-curve order, so that file statistics prune on several metadata dimensions at once.

Each dimension is quantised to 2^bits cells of about equal numbers of rows (percentiles over all rows; strings
by a number made of the six bytes after their common prefix, which keeps their order). A row's cells give its
index on a Hilbert curve, rows are sorted by it and the order is cut into runs of about `target` weight each.
Neighbours on the curve are neighbours in every dimension, so each run covers a small box and a reader with a
predicate on any of the dimensions skips most files.

The cut needs a running sum over the whole order: it is sorted into ranges, one per shuffle partition, whose sums are
put in order first; rows then add a running sum within their range.

Defined cases. Nulls are in the lowest cell. Strings that agree in the bytes used share cells. Null or negative
weights count as zero. Ties on the curve are in order of the id, null ids first; repeated rows lie side by side. Further
columns are ignored by `assign` and carried by `write_shards`. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, other_names, small_or_shuffled

BITS = 4
DIMENSIONS = ("lang", "source", "n_chars")
#: Characters in a shard of documents.
TARGET = 16_000_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points given by a row of cells each (Skilling's transposed form, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _common_prefix(a: str | None, b: str | None) -> int:
    n = 0
    while a and b and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _numbers(df: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    """Each dimension as an order-preserving number."""
    kinds = dict(df.dtypes)
    strings = [d for d in dimensions if kinds[d] == "string"]
    ends = df.agg(*[f(F.col(f"`{d}`")).alias(f"{k}_{i}") for i, d in enumerate(strings) for k, f in (("min", F.min), ("max", F.max))]).first() if strings else None
    skip = {d: _common_prefix(ends[f"min_{i}"], ends[f"max_{i}"]) for i, d in enumerate(strings)}
    out = []
    for d in dimensions:
        c = F.col(f"`{d}`")
        if d in skip:
            head = F.substring(F.rpad(F.substring(c.cast("binary"), len_bytes(ends[f"min_{strings.index(d)}"], skip[d]) + 1, 6), 6, F.lit(b"\0")), 1, 6)
            out.append(F.conv(F.hex(head), 16, 10).cast("double"))
        else:
            out.append(c.cast("double"))
    return out


def len_bytes(text: str | None, chars: int) -> int:
    return len((text or "")[:chars].encode())


def assign(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, weight: str = "n_chars", target: int = TARGET, id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(id, hilbert, shard) of every row."""
    if bits * len(dimensions) > 24:
        raise ValueError("2^24 curve cells at most: fewer bits or dimensions")
    bound_batches(df.sparkSession)
    numbers = _numbers(df, dimensions)
    flat = df.select(F.col(f"`{id_col}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0)), F.lit(0)).alias("w"), *[c.alias(f"d{i}") for i, c in enumerate(numbers)])
    cells = 1 << bits
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = flat.agg(*[F.percentile_approx(f"d{i}", shares, 10_000).alias(f"c{i}") for i in range(len(dimensions))]).first()
    edges = [np.array(sorted(set(cuts[f"c{i}"] or []))) for i in range(len(dimensions))]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        found = [np.where(c.isna(), 0, np.searchsorted(e, c.fillna(0).to_numpy(dtype=float), side="right")) for c, e in zip(columns, edges)]
        return pd.Series(hilbert_index(np.stack(found, 1), bits))

    rows = checkpointed(flat.select("id", "w", index(*[F.col(f"d{i}") for i in range(len(dimensions))]).alias("hilbert")))
    # The order is cut into ranges by (index, id), so that a full cell is several tasks' work; a running sum over the ranges, then within each.
    by = ["hilbert", F.col("id").asc_nulls_first(), "w"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("part").agg(F.sum("w").alias("total"))
    before = sums.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("w").over(W.partitionBy("part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(before), "part")
    return placed.select(F.col("id").alias(id_col), "hilbert", F.floor((F.col("before") + F.col("within")) / target).cast("long").alias("shard"))


def write_shards(df: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS, weight: str = "n_chars", target: int = TARGET, id_col: str = "doc_id", bits: int = BITS) -> None:
    """Write all columns of `df` in curve order, each shard a run of one file: file statistics then prune on every dimension."""
    name = other_names(df, "hilbert_", "shard_")
    placed = assign(df, dimensions, weight, target, id_col, bits).groupBy(id_col).agg(F.min(F.struct("hilbert", "shard")).alias("p"))  # rows of one id stay together
    placed = checkpointed(placed.select(F.col(id_col), F.col("p.hilbert").alias(name["hilbert_"]), F.col("p.shard").alias(name["shard_"])))
    joined = df.join(small_or_shuffled(placed), df[id_col].eqNullSafe(placed[id_col]), "left").drop(placed[id_col])
    n = (placed.agg(F.max(name["shard_"])).first()[0] or 0) + 1
    joined.repartitionByRange(n, name["shard_"]).sortWithinPartitions(name["shard_"], name["hilbert_"], id_col).select(*[F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").parquet(path)
