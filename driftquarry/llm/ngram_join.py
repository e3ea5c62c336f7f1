"""Exact Jaccard self-join on word n-grams, by vertical partitioning.

The n-grams of all documents have one global order: by how many documents have them (in classes of an
eighth of a doubling, rare ones first), then by hash. The order is cut into fragments; a fragment holds the
documents' n-grams of its range, counts the overlaps of pairs there, and the partial counts are summed per
pair. The steps:

1. `_scatter`: each document's n-gram set, split by hash range; n-grams travel as packed arrays, not rows.
2. `_frequencies`: a hash range counts the documents of each n-gram and sends back the repeated ones.
   Since J(x, y) >= t needs t*|x| common n-grams, documents with fewer repeated ones are done with.
3. Documents with the same set are one member from here on; how many they are is carried.
4. `_candidates`: rarest-first prefixes meet in ranges of the order. A pair with J >= t shares an n-gram of both
   prefixes, so passages that very many documents share meet nowhere unless they fill a document. The
   documents of an n-gram that more than `HOT` have are split into groups, and each two groups meet apart.
5. `_blocks_of`: candidate pairs are put into blocks. The pairs around one document (the smallest that the
   first of a pair meets) share a block, or a grid of blocks if they are many; so a document's n-grams go to
   the few blocks that name it, and pairs to each of the order's `FRAGMENTS` fragments, a constant: neither
   grows with the other.
6. `_partial`: a fragment counts the overlaps of a block's pairs; `_decide` sums a block's fragments.

What comes out are classes: pairs are decided, counted and linked inside blocks, and a block gives a row for each
of its documents, not for each pair. `near_classes` has a row for every document; `ngram_join` lists pairs of
distinct sets for those who want them, and one row for each further copy. `drop_near` needs groups only, and gets them
in two rounds without meeting all pairs of a group (`_groups_only`). Nothing is capped.

Defined cases. Words are split at white space, lower-cased and freed of all but letters and digits. A text
of fewer than n words has one n-gram of all its words; null texts and texts without words have none and
match nothing. Rows with a null id can't be named and are left out. Repeated rows are one document; where one id
has several sets of n-grams, each counts as a document of its own, the id's row adds up their links and has the
smallest of their classes, and `ngram_join` leaves pairs within the id out. Ties at the threshold belong to the
result. Further columns are ignored. An empty table gives an empty result.

The input is scanned as stored: rows of a chunk must come in the same order if a task runs again, as they
do from a table. Hashes have 64 bits in a document's set and 48 or more, growing with the input, afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import binaries, bound_batches, checkpointed, mix, n_buckets, small_or_shuffled, split_by, spread, text_slices, window_owner, windows, word_hashes

N, THRESHOLD = 5, 0.45
#: Meetings of n-grams in a range of prefixes; documents of an n-gram beyond which they are split into groups.
MEETING, HOT = 10_000_000, 1_000
#: Documents of a range up to which pairs are marked in a table.
MARKED = 6_000
#: Fragments of the global order, n-grams in one fragment of a block, candidate pairs of a block.
FRAGMENTS, FRAGMENT, BLOCK = 4, 2_000_000, 100_000

#: bucket and chunk name the packed arrays; of a chunk's own row (kind 1): ids, sizes and set signatures.
_PACKED = "bucket int, chunk long, kind int, docs binary, low binary, high binary"
_MEMBERS = "doc_id long, row long, size int, sig binary, grams binary"


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of every distinct n-gram, in order of text and hash."""
    offsets, words = word_hashes(texts, normalise=True)
    start, owner = window_owner(offsets, n)
    grams, owners = [windows(words, n)[start] if len(start) else np.zeros(0, np.uint64)], [owner]
    length = np.diff(offsets)
    for k in range(1, n):  # short texts
        short = np.flatnonzero(length == k)
        if len(short):
            grams.append(windows(words, k)[offsets[short]] + np.uint64(k))
            owners.append(short)
    h, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.int32), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _steps(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Document numbers as steps from the one before, from 0 at each start: they compress well."""
    out = np.diff(docs, prepend=0)
    out[starts] = docs[starts]
    return out.astype(np.uint32)


def _scatter(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 20  # a task's slices and a slice's texts have room in a row's number
    for batch in text_slices(batches, "text"):
        chunk += 1
        m = batch.num_rows
        doc, h = ngram_sets(batch.column("text"), n)
        size = np.bincount(doc, minlength=m).astype(np.uint32)
        sums = [np.zeros(m, np.uint64), np.zeros(m, np.uint64)]
        if len(h):
            at = np.flatnonzero(size)
            cuts = np.searchsorted(doc, at)
            sums[0][at] = np.add.reduceat(h, cuts)
            sums[1][at] = np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), cuts)
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order, names, bounds = split_by(bucket, buckets)
        low = h[order]
        own = (chunk * 0x9E3779B1) % buckets
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(names.astype(np.int32), np.int32(own)), pa.int32()),
                pa.array(np.full(len(names) + 1, chunk), pa.int64()),
                pa.array(np.append(np.zeros(len(names), np.int32), np.int32(1)), pa.int32()),
                pa.concat_arrays([binaries(_steps(doc[order], bounds[:-1]), bounds), pa.array([np.asarray(batch.column("doc_id"), dtype=np.int64).tobytes()], pa.binary())]),
                pa.concat_arrays([binaries(low.astype(np.uint32), bounds), pa.array([size.tobytes()], pa.binary())]),
                pa.concat_arrays([binaries((low >> np.uint64(32)).astype(np.uint8), bounds), pa.array([np.stack(sums, 1).tobytes()], pa.binary())]),
            ],
            names=["bucket", "chunk", "kind", "docs", "low", "high"],
        )


def _joined(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays one after another, and their lengths."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for c in column.chunks for x in c]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(x) for x in parts], dtype=np.int64)


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one hash range: the n-grams that several documents have, back by chunk, with the class of their frequency in `high` beside the hash."""
    kind = np.asarray(table.column("kind"))
    own, packed = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
    if not packed.num_rows:
        return own
    low, lengths = _joined(packed.column("low"), np.uint32)
    high, _ = _joined(packed.column("high"), np.uint8)
    steps, _ = _joined(packed.column("docs"), np.uint32)
    key = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    order = np.argsort(key)
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    often = np.diff(np.append(starts, len(ordered)))
    df = np.empty(len(key), np.int64)
    df[order] = np.repeat(often, often)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    docs = np.cumsum(steps.astype(np.int64))
    docs -= np.repeat((docs - steps)[first[lengths > 0]], lengths[lengths > 0])
    kept = df > 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(lengths)))])
    some = np.diff(bounds) > 0
    begin = bounds[:-1][some]
    cls = np.minimum(255, np.floor(8 * np.log2(np.maximum(df[kept], 1)))).astype(np.uint8)
    out = pa.table(
        {
            "bucket": packed.column("bucket").combine_chunks().filter(pa.array(some)),
            "chunk": packed.column("chunk").combine_chunks().filter(pa.array(some)),
            "kind": pa.array(np.zeros(int(some.sum()), np.int32)),
            "docs": binaries(_steps(docs[kept], begin), bounds).filter(pa.array(some)),
            "low": binaries(low[kept], bounds).filter(pa.array(some)),
            "high": binaries(np.stack([high[kept], cls], 1).reshape(-1), bounds * 2).filter(pa.array(some)),
        }
    )
    return pa.concat_tables([own.cast(out.schema), out])


def _members(table: pa.Table, threshold: float) -> pa.Table:
    """Of one chunk: documents whose repeated n-grams may reach the threshold, with those in global order."""
    kind = np.asarray(table.column("kind"))
    own, packed = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
    ids = np.frombuffer(own.column("docs")[0].as_buffer(), np.int64)
    size = np.frombuffer(own.column("low")[0].as_buffer(), np.uint32).astype(np.int64)
    sigs = own.column("high")[0].as_py()
    low, lengths = _joined(packed.column("low"), np.uint32)
    high, _ = _joined(packed.column("high"), np.uint8)
    high = high.reshape(-1, 2).astype(np.uint64)
    steps, _ = _joined(packed.column("docs"), np.uint32)
    bucket = np.repeat(np.asarray(packed.column("bucket"), dtype=np.uint64), lengths)
    docs = np.cumsum(steps.astype(np.int64))
    if len(docs):
        docs -= np.repeat((docs - steps)[np.cumsum(lengths) - lengths], lengths)
    count = np.bincount(docs, minlength=len(ids))
    stay = (size > 0) & (count >= np.ceil(threshold * size - 1e-9))
    kept = stay[docs]
    gram = mix(bucket[kept] << np.uint64(40) | high[kept, 0] << np.uint64(32) | low[kept].astype(np.uint64))
    gram = high[kept, 1] << np.uint64(56) | gram >> np.uint64(8)
    docs = docs[kept]
    order = np.argsort(gram)
    order = order[np.argsort(docs[order].astype(np.int32), kind="stable")]
    at = np.flatnonzero(stay)
    bounds = np.append(np.searchsorted(docs[order], at), len(docs))
    return pa.table(
        {
            "doc_id": pa.array(ids[at]),
            "row": pa.array(own.column("chunk")[0].as_py() * (1 << 23) + at),
            "size": pa.array(size[at].astype(np.int32)),
            "sig": pa.array([sigs[16 * i : 16 * i + 16] for i in at], pa.binary()),
            "grams": binaries(gram[order], bounds),
        }
    )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("grams"):
            total += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])


def _cuts(cells: list[tuple[int, int]], limit: int, meetings: bool = False) -> np.ndarray:
    """Cuts of the global order into ranges of about `limit` n-grams (or meetings: each counts as often as documents have it): whole cells of the leading 16 bits, or even parts of a large one, since hashes are spread evenly within."""
    cuts, filled = [], 0
    for cell, n in cells:
        n = round(n * 2 ** ((cell >> 8) / 8)) if meetings else n
        parts = -(-n // limit)
        if filled and filled + n > limit:
            cuts.append(cell << 48)
            filled = 0
        cuts += [(cell << 48) + (i << 48) // parts for i in range(1, parts)]
        filled = filled + n if parts == 1 else n // parts
    return np.array(cuts, dtype=np.uint64)


def _groups(cls: np.ndarray) -> np.ndarray:
    """Into how many groups the documents of an n-gram of this class of frequency are split."""
    return np.ceil(2 ** ((cls.astype(np.float64) + 1) / 8) / HOT).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], threshold: float, pivots: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """Prefix entries by range of the order, or for n-grams that very many have by two groups of their documents, packed."""
    for batch in batches:
        ids, labels, size = (np.asarray(batch.column(c)).astype(np.int64) for c in ("doc_id", "label", "size"))
        grams, lengths = _joined(pa.chunked_array([batch.column("grams")]), np.uint64)
        # n-grams of no other document come first in the order; they take up part of the prefix.
        take = np.clip(size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1 - (size - lengths), 0, lengths)
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(take)), take)
        place = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
        g = grams[first[owner] + place]
        place += (size - lengths)[owner]
        fragment, side = np.searchsorted(pivots, g, side="right"), np.zeros(len(g), np.int64)
        n = _groups(g >> np.uint64(56))
        at = np.flatnonzero(n > 1)
        if len(at):
            # Each entry meets every group, its own included; within a pair of groups only the two sides meet.
            own = (mix(ids[owner[at]].astype(np.uint64)) % n[at].astype(np.uint64)).astype(np.int64)
            from_ = np.repeat(np.arange(len(at)), n[at])
            other = np.arange(len(from_)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            mine = own[from_]
            cell = np.minimum(mine, other) * n[at][from_] + np.maximum(mine, other)
            key = mix(g[at][from_] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            cold = n <= 1
            g, owner, place = np.concatenate([g[cold], key]), np.concatenate([owner[cold], owner[at][from_]]), np.concatenate([place[cold], place[at][from_]])
            fragment = np.concatenate([fragment[cold], len(pivots) + 1 + (key % np.uint64(hot)).astype(np.int64)])
            side = np.concatenate([side[cold], np.where(mine == other, 0, np.where(mine < other, 1, 2))])
        order, names, bounds = split_by(fragment, len(pivots) + 1 + hot)
        order = np.concatenate([o[np.argsort(owner[o], kind="stable")] for o in np.split(order, bounds[1:-1])]) if len(order) else order
        info = (size[owner] << 32 | side << 30 | place)[order]
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), binaries(g[order], bounds), *_runs(owner[order], bounds, ids), _runs(owner[order], bounds, labels)[0], binaries(info, bounds)], names=["fragment", "grams", "ids", "counts", "labels", "info"])


def _runs(owner: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of entries in order of document within each fragment: the documents' ids and how many entries each has."""
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    new[bounds[:-1]] = True
    starts = np.flatnonzero(new)
    cuts = np.searchsorted(starts, bounds)
    return binaries(ids[owner[starts]], cuts), binaries(np.diff(np.append(starts, len(owner))).astype(np.uint32), cuts)


def _ends(*keys: np.ndarray) -> np.ndarray:
    """For each entry of sorted arrays, where its run of equal keys ends."""
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(np.concatenate([[True], new])) if len(keys[0]) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(keys[0]))
    return np.repeat(ends, ends - starts)


def _pairs_of_runs(key: np.ndarray, group: np.ndarray, star: bool, limit: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries of one key, some millions at a time: all whose groups differ, or with `star` the first of each key with all others. Arrays are sorted by key, then group."""
    ends = _ends(key)
    first = np.arange(len(key)) + 1 if star else _ends(key, group)
    left = ends - first  # partners after each entry
    if star:
        left[np.flatnonzero(key[1:] == key[:-1]) + 1] = 0
    total, at = np.cumsum(left), 0
    while at < len(key):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        n = left[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        yield i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def _candidates(table: pa.Table, threshold: float, star: bool) -> pa.Table:
    """Of one range: pairs of different labels (or stars, see `_pairs_of_runs`) that share a prefix n-gram and whose sizes and places leave room for the overlap needed."""
    gram, info = _joined(table.column("grams"), np.uint64)[0], _joined(table.column("info"), np.int64)[0]
    counts = _joined(table.column("counts"), np.uint32)[0]
    doc, label = (np.repeat(_joined(table.column(c), np.int64)[0], counts) for c in ("ids", "labels"))
    order = np.lexsort((doc, label, gram))
    gram, doc, label, info = gram[order], doc[order], label[order], info[order]
    size, side, place = info >> 32, info >> 30 & 3, info & 0x3FFFFFFF
    ids, doc = np.unique(doc, return_inverse=True)
    n = len(ids)
    # Pairs met are marked in a table of all pairs where that is small, else sorted.
    marked, found = np.zeros(n * n if n <= MARKED else 0, bool), np.zeros(0, np.int64)
    for i, j in _pairs_of_runs(gram, label, star):
        need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)
        ok = (np.minimum(size[i] - place[i], size[j] - place[j]) >= need) & (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9) & (doc[i] != doc[j]) & ((side[i] == 0) | (side[i] != side[j]))
        key = np.minimum(doc[i[ok]], doc[j[ok]]) * n + np.maximum(doc[i[ok]], doc[j[ok]])
        if n <= MARKED:
            marked[key] = True
        else:
            found = np.unique(np.concatenate([found, np.unique(key)]))
    found = np.flatnonzero(marked) if n <= MARKED else found
    return pa.table({"a": ids[found // max(n, 1)], "b": ids[found % max(n, 1)]})


def _blocks_of(pairs: DataFrame, blocks: int) -> DataFrame:
    """(a, b, block): pairs with the block that each is decided in."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    named = pairs.join(small_or_shuffled(least), "a")
    # Labels with more pairs than half a block get a grid of cells; there are at most 2 * pairs / BLOCK of them.
    many = checkpointed(named.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 2).select("label", F.ceil(F.sqrt(2 * F.col("n") / BLOCK)).cast("long").alias("grid")))
    named = named.join(small_or_shuffled(many), "label", "left").withColumn("grid", F.coalesce("grid", F.lit(1).cast("long")))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("grid"))
    return named.select("a", "b", F.pmod(F.xxhash64("label", part("a"), part("b")), F.lit(blocks)).cast("int").alias("block"))


_BLOCK = "fragment int, block int, kind int, ids binary, counts binary, info binary"


def _segments(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document's n-grams cut at the pivots, to the fragments of its block (kind 0); its size and number of copies to the first (kind 2)."""
    cuts = len(pivots) + 1
    for batch in batches:
        ids, size, copies, block = (np.asarray(batch.column(c)).astype(np.int64) for c in ("doc_id", "size", "copies", "block"))
        grams, lengths = _joined(pa.chunked_array([batch.column("grams")]), np.uint64)
        owner = np.repeat(np.arange(len(ids)), lengths)
        order, names, bounds = split_by(block[owner] * cuts + np.searchsorted(pivots, grams, side="right"), 1 << 32)
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array((names % cuts).astype(np.int32)), pa.array((names // cuts).astype(np.int32)), pa.array(np.zeros(n, np.int32)), *_runs(owner[order], bounds, ids), binaries(grams[order], bounds)], names=["fragment", "block", "kind", "ids", "counts", "info"])
        order, names, bounds = split_by(block, 1 << 32)
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(names.astype(np.int32)), pa.array(np.full(n, 2, np.int32)), binaries(ids[order], bounds), binaries(size[order], bounds), binaries(copies[order], bounds)], names=["fragment", "block", "kind", "ids", "counts", "info"])


def _pairs_out(batches: Iterator[pa.RecordBatch], fragments: int) -> Iterator[pa.RecordBatch]:
    """Pairs packed by block, to every fragment (kind 1)."""
    for batch in batches:
        a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        order, names, bounds = split_by(np.asarray(batch.column("block")).astype(np.int64), 1 << 32)
        first, second, empty = binaries(a[order], bounds), binaries(b[order], bounds), pa.array([b""] * len(names), pa.binary())
        for fragment in range(fragments):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), fragment, np.int32)), pa.array(names.astype(np.int32)), pa.array(np.ones(len(names), np.int32)), first, empty, second], names=["fragment", "block", "kind", "ids", "counts", "info"])


def _partial(table: pa.Table) -> pa.Table:
    """Of one fragment and block: how many of the fragment's n-grams each pair has in common, in order of the pairs; from the first fragment also the pairs, sizes and copies."""
    kind = np.asarray(table.column("kind"))
    parts, named, sized = (table.filter(pa.array(kind == k)) for k in (0, 1, 2))
    pairs = np.stack([_joined(named.column(c), np.int64)[0] for c in ("ids", "info")], 1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    common = np.zeros(len(pairs), np.uint32)
    grams = _joined(parts.column("info"), np.uint64)[0]
    if len(grams) and len(pairs):
        run_ids, counts = _joined(parts.column("ids"), np.int64)[0], _joined(parts.column("counts"), np.uint32)[0]
        ids, run = np.unique(run_ids, return_inverse=True)
        doc, rank = np.repeat(run, counts), np.unique(grams, return_inverse=True)[1]
        order = np.argsort(doc, kind="stable")
        rank, bounds = rank[order], np.searchsorted(doc[order], np.arange(len(ids) + 1))
        at = np.minimum(np.searchsorted(ids, pairs), len(ids) - 1)
        here = np.flatnonzero((ids[at] == pairs).all(1))
        x, y = at[here].T
        mark = np.zeros(int(rank.max()) + 1, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        for start, stop in zip(starts, np.append(starts[1:], len(x))):
            own = rank[bounds[x[start]] : bounds[x[start] + 1]]
            mark[own] = 1
            for s in range(start, stop, 2000):
                ys = y[s : min(stop, s + 2000)]
                n = bounds[ys + 1] - bounds[ys]
                first = np.cumsum(n) - n
                common[here[s : s + len(ys)]] = np.add.reduceat(mark[rank[np.repeat(bounds[ys] - first, n) + np.arange(int(n.sum()))]], first)
            mark[own] = 0
    out = {"block": table.column("block").slice(0, 1), "counts": pa.array([common.tobytes()], pa.binary())}
    first = table.column("fragment")[0].as_py() == 0
    out["a"] = pa.array([np.ascontiguousarray(pairs[:, 0]).tobytes() if first else None], pa.binary())
    out["b"] = pa.array([np.ascontiguousarray(pairs[:, 1]).tobytes() if first else None], pa.binary())
    for name, column in (("ids", "ids"), ("sizes", "counts"), ("copies", "info")):
        out[name] = pa.array([_joined(sized.column(column), np.int64)[0].tobytes() if first else None], pa.binary())
    return pa.table(out)


_PARTS = "block int, counts binary, a binary, b binary, ids binary, sizes binary, copies binary"


def _decided(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: partial counts summed; documents, their copies, and the pairs (by their places among the documents) at or above the threshold with their Jaccard index."""
    first = table.filter(table.column("a").is_valid())
    if not first.num_rows:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing, np.zeros(0)
    a, b, ids, sizes, copies = (np.frombuffer(first.column(c)[0].as_buffer(), np.int64) for c in ("a", "b", "ids", "sizes", "copies"))
    common = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for c in table.column("counts").chunks for x in c)
    ids, at = np.unique(ids, return_index=True)
    sizes, copies = sizes[at], copies[at]
    x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
    jaccard = common / (sizes[x] + sizes[y] - common)
    near = jaccard >= threshold
    return ids, copies, x[near], y[near], jaccard[near]


def _listed(table: pa.Table, threshold: float) -> pa.Table:
    ids, _, x, y, jaccard = _decided(table, threshold)
    return pa.table({"a": ids[x], "b": ids[y], "jaccard": jaccard})


def local_roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n vertices' component by edges (x, y)."""
    root = np.arange(n)
    while True:
        u, v = root[x], root[y]
        if (u == v).all():
            return root
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not (root == root[root]).all():
            root = root[root]


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """Of one block: by document with a link there, how many documents it is linked to and the first one that it is connected with."""
    ids, copies, x, y, _ = _decided(table, threshold)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, x, copies[y])
    np.add.at(links, y, copies[x])
    root, some = local_roots(x, y, len(ids)), links > 0
    return pa.table({"row": ids[some], "links": links[some], "root": ids[root[some]]})


def _sets(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[int, int]]]:
    """Documents that may have a partner (doc_id, sig, size), the first of each set of these (sig, size, row, rep, copies), the sets (doc_id, which is their row, size, copies, grams), and how many of their n-grams lie in each cell of the order."""
    bound_batches(docs.sparkSession)
    buckets = n_buckets(docs)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(lambda it: _scatter(it, n=n, buckets=buckets), _PACKED)
    repeated = packed.groupBy("bucket").applyInArrow(_frequencies, _PACKED)
    members = checkpointed(repeated.groupBy("chunk").applyInArrow(lambda t: _members(t, threshold=threshold), _MEMBERS))
    one = members.groupBy("sig", "size", "doc_id").agg(F.min("row").alias("row"))
    heads = one.groupBy("sig", "size").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.count("*").alias("copies"))
    heads = checkpointed(heads.select("sig", "size", F.col("head.row").alias("row"), F.col("head.doc_id").alias("rep"), "copies"))
    reps = members.select("row", "size", "grams").join(small_or_shuffled(heads.select("row", "copies")), "row").withColumnRenamed("row", "doc_id")
    cells = sorted(map(tuple, reps.mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect()))
    return members.select("doc_id", "sig", "size").distinct(), heads, reps, cells


def _met(reps: DataFrame, cells: list[tuple[int, int]], threshold: float, star: bool = False, labels: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: pairs of sets that may be near, of all, or of those whose labels (doc_id, label; one's own by default) differ, or stars."""
    reps = reps.withColumn("label", F.col("doc_id")) if labels is None else reps.join(small_or_shuffled(labels), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    cold = [(cell, k) for cell, k in cells if _groups(np.array([cell >> 8]))[0] == 1]
    meets = sum(k * 2 ** ((cell >> 8) / 8) for cell, k in cells) - sum(k * 2 ** ((cell >> 8) / 8) for cell, k in cold)
    pivots, hot = _cuts(cold, MEETING, meetings=True), max(1, round(meets / MEETING))
    prefixes = reps.select("doc_id", "label", "size", "grams").mapInArrow(lambda it: _prefixes(it, threshold=threshold, pivots=pivots, hot=hot), "fragment int, grams binary, ids binary, counts binary, labels binary, info binary")
    found = spread(prefixes, len(pivots) + 1 + hot, "fragment").groupBy("fragment").applyInArrow(lambda t: _candidates(t, threshold, star), "a long, b long")
    return checkpointed(found.distinct())


def _counted(reps: DataFrame, cells: list[tuple[int, int]], candidates: DataFrame) -> GroupedData:
    """The blocks of pairs with the partial counts of all fragments."""
    total = sum(k for _, k in cells)
    blocks = max(1, -(-candidates.count() // BLOCK), -(-total // (FRAGMENTS * FRAGMENT)))
    placed = checkpointed(_blocks_of(candidates, blocks))
    named = checkpointed(placed.select("block", F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    cuts = _cuts(cells, max(1, -(-total // FRAGMENTS)))
    segments = reps.join(small_or_shuffled(named), "doc_id").select("doc_id", "size", "copies", "block", "grams").mapInArrow(lambda it: _segments(it, pivots=cuts), _BLOCK)
    pairs = placed.mapInArrow(lambda it: _pairs_out(it, fragments=len(cuts) + 1), _BLOCK)
    parts = spread(segments.unionByName(pairs), (len(cuts) + 1) * blocks, "fragment", "block").groupBy("fragment", "block").applyInArrow(_partial, _PARTS)
    return parts.groupBy("block")


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: every pair of distinct n-gram sets with a Jaccard index of `threshold` or more, by their representatives (the smallest ids), and every further document of a set with its representative."""
    members, heads, reps, cells = _sets(docs, n, threshold)
    near = _counted(reps, cells, _met(reps, cells, threshold)).applyInArrow(lambda t: _listed(t, threshold), "a long, b long, jaccard double")
    for side in "ab":
        near = near.join(small_or_shuffled(heads.select(F.col("row").alias(side), F.col("rep").alias(f"doc_{side}"))), side)
    near = near.where("doc_a <> doc_b").groupBy(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))
    copies = members.join(small_or_shuffled(heads), ["sig", "size"]).where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    near = near.unionByName(copies.distinct().withColumn("jaccard", F.lit(1.0)))
    return near.select("doc_a", "doc_b", F.round("jaccard", 6).alias("jaccard"))


_LINKED = "row long, links long, root long"


def _named(members: DataFrame, heads: DataFrame, roots: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id, links) of the documents that have a link, from roots of rows; links are those of copies alone where they weren't counted."""
    sets = heads.join(roots, "row", "left")
    sets = sets.join(links, "row", "left") if links is not None else sets.withColumn("links", F.lit(0).cast("long"))
    sets = sets.select("sig", "size", "rep", F.coalesce("root", "row").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("root").isNotNull().alias("linked")).where("links > 0 OR linked")
    sets = checkpointed(sets)
    first = sets.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = checkpointed(sets.join(first, "root").select("sig", "size", "class_id", "links"))
    return members.join(small_or_shuffled(named), ["sig", "size"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def _roots(linked: DataFrame) -> DataFrame:
    """(row, root) of all rows in a link, roots included."""
    found = components(linked.select(F.col("row").alias("doc_a"), F.col("root").alias("doc_b"))).select(F.col("doc_id").alias("row"), "root")
    return found.unionByName(found.select(F.col("root").alias("row"), "root")).distinct()


def _classes(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, class_id, links) of the documents that have a link, every pair of different sets counted."""
    members, heads, reps, cells = _sets(docs, n, threshold)
    linked = checkpointed(_counted(reps, cells, _met(reps, cells, threshold)).applyInArrow(lambda t: _linked(t, threshold), _LINKED))
    return _named(members, heads, _roots(linked), linked.groupBy("row").agg(F.sum("links").alias("links")))


def _groups_only(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, class_id) of the documents that have a link, without meeting all pairs of a group.

    First each n-gram's first set meets the others that have it; what is near by that forms groups. Then sets of
    different groups that share an n-gram meet. Two sets at or above the threshold are in one group after the first
    round or meet in the second, so the groups are exactly those of all pairs.
    """
    members, heads, reps, cells = _sets(docs, n, threshold)
    stars = checkpointed(_counted(reps, cells, _met(reps, cells, threshold, star=True)).applyInArrow(lambda t: _linked(t, threshold), _LINKED))
    roots = checkpointed(_roots(stars))
    across = _met(reps, cells, threshold, labels=roots.select(F.col("row").alias("doc_id"), F.col("root").alias("label")))
    rest = checkpointed(_counted(reps, cells, across).applyInArrow(lambda t: _linked(t, threshold), _LINKED))
    edges = roots.unionByName(rest.select("row", "root"))
    return _named(members, heads, checkpointed(_roots(edges))).select("doc_id", "class_id")


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of every document with an id: the smallest id of the documents that links connect it with (its own without any), and to how many documents it has a link, a Jaccard index of `threshold` or more."""
    linked = checkpointed(_classes(docs, n, threshold))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    every = ids.join(small_or_shuffled(linked), "doc_id", "left")
    return every.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, root): the smallest id of each document's connected component, for documents in a pair, by alternating stars (large, then small) until nothing changes."""
    from pyspark.sql import Window as W

    edges = checkpointed(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u"))))
        large = around.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("doc_id"), "root")
        state = new


def drop_near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without near copies: of each class, the document with the smallest id stays; same columns. Rows with a null id stay."""
    later = checkpointed(_groups_only(docs, n, threshold).where("doc_id <> class_id").select("doc_id"))
    return docs.join(small_or_shuffled(later), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
