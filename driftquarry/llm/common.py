"""Pieces shared by the operators: Arrow batch bounds, tokenising, rolling fingerprints, bucket payloads, checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken in slices of about this many bytes, whatever the batch: it bounds a worker's memory.
SLICE_BYTES = 3 << 20
#: Rows that a broadcast side may have; beyond it, operators use a shuffled join instead.
BROADCAST_ROWS = 2_000_000
#: Stored bytes of a bucket, the most buckets, an estimate that says the size is unknown; the most tasks of a `spread`.
TEXT_BYTES, MOST_BUCKETS, UNKNOWN_BYTES, MOST_TASKS = 32 << 20, 1 << 22, 1 << 55, 50_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be long, and executors give Python little memory. Let Python workers find this package where it is not installed."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH", ""), root]))
    # Workers live on between tasks: what they free goes back to the system, but for 64 MB that are used over and over.
    known.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    known.setdefault("MALLOC_MMAP_THRESHOLD_", str(16 << 20))
    known.setdefault("MALLOC_TRIM_THRESHOLD_", str(64 << 20))
    known.setdefault("MALLOC_ARENA_MAX", "2")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where that setting is unset (as in tests) a folder is made in local mode only; on a cluster its absence
    is an error, since a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a checkpointed side for broadcast if its row count allows it; else leave it to a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def n_buckets(df: DataFrame) -> int:
    """Buckets of a hash or value range: of about TEXT_BYTES of stored input each by the optimizer's estimate, and four per shuffle partition or 256 at least."""
    least = max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(-(-size // TEXT_BYTES), MOST_BUCKETS)) if size < UNKNOWN_BYTES else least


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Hash-partition by the keys of groups that cost more than their bytes say: partitions that adaptive execution doesn't join up."""
    return df.repartition(max(1, min(2 * int(groups), MOST_TASKS)), *keys)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about `limit` bytes; one longer text makes a slice of its own."""
    for batch in batches:
        n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(n), 0
        while start < len(n):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Split at white space: offsets by text and the words, dictionary-encoded; empty strings are still among them."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    return np.asarray(split.offsets, dtype=np.int64) - split.offsets[0].as_py(), split.flatten().dictionary_encode()


def word_hashes(texts: pa.Array, normalise: bool) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by text, 64-bit hash of each word). With normalise, words are lower-cased and freed of all but letters and digits; words that become empty are left out."""
    offsets, words = words_of(texts)
    unique = words.dictionary
    if normalise:
        unique = pc.replace_substring_regex(pc.utf8_lower(unique), r"[^\pL\pN]+", "")
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else 0 for w in unique.to_pylist()), np.uint64, len(unique))
    if not len(table):
        return np.zeros_like(offsets), np.zeros(0, np.uint64)
    hashes = table[np.asarray(words.indices)]
    kept = hashes != 0
    return np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int64), hashes[kept]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (in place)."""
    h ^= h >> _S33
    h *= _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S33
    return h


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 18), base, np.uint64)
        a[0] = 1
        have = _powers[str(base)] = np.cumprod(a)
    return have[:n]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the n words from each position, by prefix sums of a polynomial modulo 2^64; windows across texts are the caller's to drop."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power(_BASE, len(hashes)))])
    return mix((sums[n:] - sums[:-n]) * _power(_BASE_INV, len(hashes) - n + 1))


def window_owner(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of n words that lie within one text: (start positions in the whole slice, number of the text)."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - first[owner] + offsets[:-1][owner], owner


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by bucket, the buckets that occur, and their bounds in that order."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    ordered = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return order, ordered[starts], np.append(starts, len(ordered))


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The array's bytes cut at `bounds`, as a binary column."""
    values = np.ascontiguousarray(values)
    if values.nbytes > np.iinfo(np.int32).max:
        raise OverflowError("a bucket returns more than 2 GB: it needs more buckets")
    offsets = (np.asarray(bounds, dtype=np.int64) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def other_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name, one that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out[name] = new
    return out
