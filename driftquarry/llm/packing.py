"""Packing documents into windows of fixed length, by minimum bin slack.

Documents longer than a window are cut into whole windows and a remainder. What is left is a multiset of
lengths, and that multiset, a histogram of at most `capacity` counts whatever the corpus, is all the driver
sees. It plans windows one pattern at a time: the largest remaining length opens a window; a bitset of the
sums that subsets of the remaining multiset reach gives the one closest to the space left; walking back
through the bitsets gives how often each length is used; and the pattern is repeated as long as the counts
last. Documents then find their windows by their rank among those of equal length: a join with the plan.

Defined cases. The length of a text is its number of words (white-space separated) unless a column is named.
Null and empty texts, lengths of zero or less and rows with a null id are not packed. Repeated rows are packed
once each. Equal lengths are interchangeable; ranks follow the id. Further columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, small_or_shuffled, text_slices, words_of

CAPACITY = 2048
#: Pieces of one length are ranked in parts of about so many, so that a frequent length is not one task's work.
RANKED = 500_000


def fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """The sub-multiset of `counts` (length: how many) whose sum is the largest not above `space`.

    Subset sums are bits of an integer; a length with a count is split into items of 1, 2, 4, ... copies.
    """
    reach, full, items = 1, (1 << (space + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= space), reverse=True):
        left, copies = min(counts[length], space // length), 1
        while left > 0:
            take = min(copies, left)
            items.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left -= take
            copies *= 2
        if reach >> space & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(items):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int], int]]:
    """(first window, lengths used in each, number of windows) of each pattern, until the multiset is used up."""
    counts, out, window = {k: v for k, v in histogram.items() if v > 0}, [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        used = fill(counts, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[k] // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        out.append((window, used, times))
        window += times
    return out


def _intervals(patterns: list[tuple[int, dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first window, how many in each, offset of the first) by pattern and length."""
    taken: dict[int, int] = {}
    out = []
    for window, used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            start = taken.get(length, 0)
            taken[length] = start + used[length] * times
            out.append((length, start, taken[length], window, used[length], offset))
            offset += length * used[length]
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        offsets, words = words_of(batch.column("text"))
        full = np.array([bool(w) for w in words.dictionary.to_pylist()], dtype=np.int64)
        n = np.concatenate([[0], np.cumsum(full[np.asarray(words.indices)] if len(full) else np.zeros(0, np.int64))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n[offsets[1:]] - n[offsets[:-1]])], names=["doc_id", "n"])


def pack(docs: DataFrame, capacity: int = CAPACITY, length_col: str | None = None) -> DataFrame:
    """(doc_id, piece, window_id, offset, length): where each piece of each document lies. Windows are numbered from 0; no two pieces overlap and none leaves its window."""
    spark = docs.sparkSession
    bound_batches(spark)
    if length_col:
        sized = docs.select("doc_id", F.col(f"`{length_col}`").cast("long").alias("n"))
    else:
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_lengths, "doc_id long, n long")
    sized = sized.where("doc_id IS NOT NULL AND n > 0")
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))
    pieces = checkpointed(pieces)
    histogram = {length: n for length, n in map(tuple, pieces.groupBy("length").agg(F.count("*")).collect())}
    parts = spark.createDataFrame([(length, -(-n // RANKED)) for length, n in histogram.items()], "length int, parts long")
    pieces = pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "parts").cast("int")).drop("parts")
    starts, before = [], {}
    for length, salt, n in sorted(map(tuple, pieces.groupBy("length", "salt").agg(F.count("*")).collect())):
        starts.append((length, salt, before.get(length, 0)))
        before[length] = before.get(length, 0) + n
    # One row for each length and half a million pieces; the plan is bounded by the capacity.
    starts = spark.createDataFrame(starts, "length int, salt int, start long")
    planned = spark.createDataFrame(_intervals(plan(histogram, capacity)), "length int, low long, high long, first long, each long, base int")
    ranked = pieces.withColumn("place", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(F.broadcast(starts), ["length", "salt"]).withColumn("rank", F.col("start") + F.col("place"))
    found = ranked.join(small_or_shuffled(planned), "length").where("rank >= low AND rank < high")
    slot = F.col("rank") - F.col("low")
    return found.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("first") + F.floor(slot / F.col("each"))).alias("window_id"), (F.col("base") + F.col("length") * (slot % F.col("each"))).cast("int").alias("offset"), "length")
