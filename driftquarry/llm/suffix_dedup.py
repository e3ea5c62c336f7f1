"""Repeated passages, by blockwise sorting of word suffixes with a difference cover.

A passage is repeated at a place if the `min_words` words from there also stand at an earlier place (of a
smaller id, or further left in the same document). The words of all such windows of a document merge into
spans; a span is what deduplication cuts, so the first occurrence of every passage stays.

Suffixes of all documents are sorted in buckets, one bucket at a time, so memory holds a bucket and never
the suffix array:

1. Cover sample. Positions p with p mod 31 in a perfect difference set of six residues are sampled: for any
   two positions there is a shift below 31 that takes both to sampled ones. Two equal windows of 50 words
   therefore hold equal sampled suffixes of 20 words at one shift. Buckets of the sample (a fifth of all
   suffixes) are sorted and sampled suffixes ranked by their 20-word prefix; a suffix whose rank nobody
   shares can't be in a repeat.
2. Blocks. Only documents that hold a shared rank go on. Their suffixes are split into buckets by the leading
   bits of the `min_words`-word prefix's fingerprint (a super-character of the order in which suffixes are
   sorted: equal prefixes are neighbours) and each bucket is sorted by (prefix, id, place). All 64 bits are kept.
3. Neighbours with an equal fingerprint are repeats to be confirmed; the first of them is the source.
4. Words. Neighbouring repeats with neighbouring sources are one passage, whose words are compared with the
   source's, by 128-bit digests of the words. Where they differ (fingerprints collided), all windows of the
   fingerprints concerned are grouped by the digests of their words instead. So nothing is reported, or cut, on the
   word of a fingerprint.

Positions travel as packed arrays by bucket and chunk, not as rows. Of equal prefixes in a chunk only the first goes
to a bucket; the others stay with their chunk and get what the first is told. So a passage that a third of all
documents hold weighs a chunk's worth in its bucket. Nothing is capped, and copies of any number cost what they
weigh: a run of k equal suffixes gives k - 1 places.

Defined cases. Words are split at white space and compared as they are. Texts of fewer than `min_words`
words, empty and null texts have no windows and are never cut. Rows with a null id are left alone. A row
that repeats another (same id and text) has its places equal to the other's: neither comes first, so an id's
own copy is not cut (exact deduplication removes those). Further columns are carried. An empty table gives an
empty result. A document all of whose words are cut is dropped.

The input is scanned as stored: rows of a chunk must come in the same order if a task runs again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, binaries, bound_batches, checkpointed, n_buckets, other_names, small_or_shuffled, split_by, text_slices, window_owner, windows, word_hashes
from .ngram_join import _joined, _steps

MIN_WORDS = 50
#: Period and residues: every difference modulo 31 occurs once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_PACKED = "bucket int, chunk long, kind int, docs binary, low binary, high binary, place binary, ids binary"


def _leading(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _packed(batches: Iterator[pa.RecordBatch], length: int, buckets: int, sample: bool, bits: int = 64) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the `length`-word prefixes of suffixes, by bucket: of sampled ones without their places, or of all with ids and places. The chunk's own row has its ids, and its ties: the documents that hold some, or all but the first of each with the first's place."""
    chunk = TaskContext.get().partitionId() << 32
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    for batch in text_slices(batches, "text"):
        chunk += 1
        offsets, words = word_hashes(batch.column("text"), normalise=False)
        start, doc = window_owner(offsets, length)
        place = start - offsets[doc]
        h = windows(words, length)
        if sample:
            kept = in_cover[place % PERIOD]
            start, doc, place = start[kept], doc[kept], place[kept]
        h = _leading(h[start], bits) if len(start) else np.zeros(0, np.uint64)
        ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
        # Texts in order of their id: the first of a run of equal prefixes is then the chunk's first.
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        order = np.lexsort((rank[doc] << 32 | place, h)) if len(h) else np.zeros(0, np.int64)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        head = order[new][np.cumsum(new) - 1] if len(h) else order
        other, head = order[~new], head[~new]
        if sample:
            tied = np.unique(np.concatenate([doc[other], doc[head]])).astype(np.uint32)
        else:
            tied = np.stack([doc[other], place[other], doc[head], place[head]], 1).astype(np.uint32)
        first = np.sort(order[new])
        h, doc, place = h[first], doc[first], place[first]
        order, names, bounds = split_by(((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), buckets)
        h, doc, place = h[order], doc[order], place[order]
        n = len(names) + 1
        empty = pa.array([b""], pa.binary())
        none = pa.array([b""] * (n - 1), pa.binary())
        present = none
        if not sample:
            starts = np.concatenate([[True], (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
            starts[bounds[:-1]] = True
            present = binaries(ids[doc[starts]], np.concatenate([[0], np.cumsum(starts)])[bounds])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(names.astype(np.int32), np.int32((chunk * 0x9E3779B1) % buckets)), pa.int32()),
                pa.array(np.full(n, chunk), pa.int64()),
                pa.array(np.append(np.zeros(n - 1, np.int32), np.int32(1)), pa.int32()),
                pa.concat_arrays([binaries(_steps(doc, bounds[:-1]), bounds), pa.array([ids.tobytes()], pa.binary())]),
                pa.concat_arrays([binaries(h.astype(np.uint32), bounds), empty]),
                pa.concat_arrays([binaries((h >> np.uint64(32)).astype(np.uint8 if sample else np.uint32), bounds), empty]),
                pa.concat_arrays([none if sample else binaries(place.astype(np.uint32), bounds), pa.array([tied.tobytes()], pa.binary())]),
                pa.concat_arrays([present, empty]),
            ],
            names=["bucket", "chunk", "kind", "docs", "low", "high", "place", "ids"],
        )


def _open(packed: pa.Table, high_type: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document number in its chunk, row, lengths) of all entries of a bucket."""
    low, lengths = _joined(packed.column("low"), np.uint32)
    high, _ = _joined(packed.column("high"), high_type)
    steps, _ = _joined(packed.column("docs"), np.uint32)
    docs = np.cumsum(steps.astype(np.int64))
    if len(docs):
        docs -= np.repeat((docs - steps)[np.cumsum(lengths) - lengths], lengths)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), docs, np.repeat(np.arange(len(lengths)), lengths), lengths


def _shared_ranks(table: pa.Table) -> pa.Table:
    """Of one bucket of the cover sample: by chunk, the documents with a suffix whose rank another chunk shares."""
    kind = np.asarray(table.column("kind"))
    own, packed = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
    out = [pa.table({"chunk": own.column("chunk"), "kind": own.column("kind"), "docs": own.column("docs"), "tied": own.column("place")})]
    if packed.num_rows:
        key, docs, row, lengths = _open(packed, np.uint8)
        order = np.argsort(key)
        ordered = key[order]
        tied = np.zeros(len(key), bool)
        same = ordered[1:] == ordered[:-1]
        tied[order[1:]] = same
        tied[order[:-1]] |= same
        pick = np.unique(row[tied] << 32 | docs[tied])
        bounds = np.searchsorted(pick >> 32, np.arange(len(lengths) + 1))
        out.append(pa.table({"chunk": packed.column("chunk"), "kind": packed.column("kind"), "docs": binaries((pick & 0xFFFFFFFF).astype(np.uint32), bounds), "tied": pa.nulls(packed.num_rows, pa.binary())}).cast(out[0].schema))
    return pa.concat_tables(out)


def _flagged(table: pa.Table) -> pa.Table:
    own = table.filter(pa.array(np.asarray(table.column("kind")) == 1))
    ids = np.frombuffer(own.column("docs")[0].as_buffer(), np.int64)
    docs, _ = _joined(table.filter(pa.array(np.asarray(table.column("kind")) == 0)).column("docs"), np.uint32)
    tied = np.frombuffer(own.column("tied")[0].as_buffer(), np.uint32)
    return pa.table({"doc_id": pa.array(ids[np.unique(np.concatenate([docs, tied]))])})


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket of suffixes: by chunk, the places of all but the first of each run of equal prefixes, with the source's id and place."""
    kind = np.asarray(table.column("kind"))
    own, packed = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
    out = [pa.table({"chunk": own.column("chunk"), "kind": own.column("kind"), "docs": own.column("docs"), "place": own.column("place"), "source": own.column("ids"), "source_place": own.column("place")})]
    if packed.num_rows:
        key, docs, row, lengths = _open(packed, np.uint32)
        place, _ = _joined(packed.column("place"), np.uint32)
        ids, _ = _joined(packed.column("ids"), np.int64)
        new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (row[1:] != row[:-1])]) if len(docs) else np.zeros(0, bool)
        doc_id = ids[np.cumsum(new) - 1]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order = order[tied]
        order = order[np.lexsort((place[order], doc_id[order], key[order]))]
        k = key[order]
        first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        head = order[first][np.cumsum(first) - 1] if len(k) else order
        later = (doc_id[order] != doc_id[head]) | (place[order] != place[head])
        at, source, source_place = order[later], doc_id[head[later]], place[head[later]]
        back = np.argsort(at)
        at, source, source_place = at[back], source[back], source_place[back]
        bounds = np.searchsorted(row[at], np.arange(len(lengths) + 1))
        begin = bounds[:-1][np.diff(bounds) > 0]
        out.append(pa.table({"chunk": packed.column("chunk"), "kind": packed.column("kind"), "docs": binaries(_steps(docs[at], begin), bounds), "place": binaries(place[at], bounds), "source": binaries(source, bounds), "source_place": binaries(source_place, bounds)}).cast(out[0].schema))
    return pa.concat_tables(out)


def _passages(table: pa.Table, length: int) -> pa.Table:
    """Of one chunk: repeated windows that follow each other, as their sources do, as one passage of words."""
    kind = np.asarray(table.column("kind"))
    ids = np.frombuffer(table.filter(pa.array(kind == 1)).column("docs")[0].as_buffer(), np.int64)
    packed = table.filter(pa.array(kind == 0))
    steps, lengths = _joined(packed.column("docs"), np.uint32)
    place, at = (_joined(packed.column(c), np.uint32)[0].astype(np.int64) for c in ("place", "source_place"))
    source, _ = _joined(packed.column("source"), np.int64)
    docs = np.cumsum(steps.astype(np.int64))
    if len(docs):
        begin = (np.cumsum(lengths) - lengths)[lengths > 0]
        docs -= np.repeat((docs - steps)[begin], lengths[lengths > 0])
    # What stayed with the chunk has the source of its chunk's first, or that itself.
    doc, where, head, head_place = np.frombuffer(table.filter(pa.array(kind == 1)).column("place")[0].as_buffer(), np.uint32).reshape(-1, 4).astype(np.int64).T
    told = np.argsort(docs << 32 | place)
    known, key = (docs << 32 | place)[told], head << 32 | head_place
    slot = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
    hit = known[slot] == key if len(known) else np.zeros(len(key), bool)
    other_source, other_at = ids[head].copy(), head_place.copy()
    if hit.any():
        other_source[hit], other_at[hit] = source[told[slot[hit]]], at[told[slot[hit]]]
    later = (ids[doc] != other_source) | (where != other_at)
    docs, place, source, at = (np.concatenate(p) for p in ((docs, doc[later]), (place, where[later]), (source, other_source[later]), (at, other_at[later])))
    order = np.lexsort((place, docs))
    docs, place, source, at = docs[order], place[order], source[order], at[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.append(new[1:], True) if len(docs) else new
    return pa.table({"doc_id": pa.array(ids[docs[new]]), "b": pa.array(place[new].astype(np.int32)), "e": pa.array((place[last] + length).astype(np.int32)), "source": pa.array(source[new]), "at": pa.array(at[new].astype(np.int32))})


def _slices(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """The words that are asked for of each text, or their digest; a text that is too short for them has none."""
    for batch in text_slices(batches, "text"):
        names, words = [], []
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
            own = [w for w in pc.utf8_split_whitespace(pa.array([text or ""]))[0].as_py() if w]
            for x in asked:
                if x["e"] <= len(own):
                    names.append((x["copy"], x["b"], x["e"]))
                    part = " ".join(own[x["b"] : x["e"]]).encode()
                    words.append(hashlib.blake2b(part, digest_size=16).digest() if digest else part)
        for start in range(0, len(names), 1000):
            part = names[start : start + 1000]
            columns = [pa.array([n[0] for n in part], pa.int64()), pa.array([n[1] for n in part], pa.int32()), pa.array([n[2] for n in part], pa.int32()), pa.array(words[start : start + 1000], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "b", "e", "words"])


def _words_at(texts: DataFrame, places: DataFrame, digest: bool = True) -> DataFrame:
    """(doc_id, b, e, words) of places (doc_id, b, e): 128-bit digests of the words, or the words as bytes."""
    asked = checkpointed(places.distinct().groupBy("doc_id").agg(F.collect_list(F.struct(F.col("doc_id").alias("copy"), "b", "e")).alias("asked")))
    few = (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST_ROWS
    return texts.join(F.broadcast(asked) if few else asked, "doc_id").select("text", "asked").mapInArrow(lambda it: _slices(it, digest), "doc_id long, b int, e int, words binary")


def _fingerprints(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "words"):
        offsets, words = word_hashes(batch.column("words").cast(pa.string()), normalise=False)
        h = np.unique(_leading(windows(words, length)[window_owner(offsets, length)[0]], bits))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _windows_of(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """All windows with their fingerprints, as places."""
    for batch in text_slices(batches, "text"):
        offsets, words = word_hashes(batch.column("text"), normalise=False)
        start, doc = window_owner(offsets, length)
        h = _leading(windows(words, length)[start], bits) if len(start) else np.zeros(0, np.uint64)
        place = (start - offsets[doc]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(place), pa.array(place + np.int32(length)), pa.array(h.view(np.int64))], names=["doc_id", "b", "e", "h"])


def _confirmed(texts: DataFrame, found: DataFrame, length: int, bits: int) -> DataFrame:
    """(doc_id, b, e, source): passages whose words equal the source's, and what remains of the others by words."""
    sourced = found.withColumn("to", F.col("at") + F.col("e") - F.col("b"))
    sides = found.select("doc_id", "b", "e").unionByName(sourced.select(F.col("source").alias("doc_id"), F.col("at").alias("b"), F.col("to").alias("e")))
    words = checkpointed(_words_at(texts, sides).distinct())  # of an id with several texts, of each
    first = words.select(F.col("doc_id").alias("source"), F.col("b").alias("at"), F.col("e").alias("to"), F.col("words").alias("source_words"))
    both = sourced.join(words, ["doc_id", "b", "e"]).join(first, ["source", "at", "to"])
    good = checkpointed(both.where("words = source_words").select("doc_id", "b", "e", "source", "at").distinct())
    bad = checkpointed(found.distinct().join(good, ["doc_id", "b", "e", "source", "at"], "left_anti"))
    good = good.drop("at")
    if bad.isEmpty():
        return good
    keys = checkpointed(_words_at(texts, bad.select("doc_id", "b", "e"), digest=False).select("words").mapInArrow(lambda it: _fingerprints(it, length, bits), "h long").distinct())
    places = texts.mapInArrow(lambda it: _windows_of(it, length, bits), "doc_id long, b int, e int, h long").join(small_or_shuffled(keys), "h", "left_semi")
    named = checkpointed(_words_at(texts, places.select("doc_id", "b", "e")))
    heads = named.groupBy("words").agg(F.min(F.struct("doc_id", "b")).alias("head"))
    again = named.join(heads, "words").where("doc_id <> head.doc_id OR b <> head.b").select("doc_id", "b", "e", F.col("head.doc_id").alias("source"))
    return good.unionByName(again)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = 64) -> DataFrame:
    """(doc_id, begin_word, end_word, source_doc_id): the spans of words of each document that repeat earlier passages of `min_words` words or more, and the document where the first window of the span stands first. `bits` of the fingerprints are used; the result does not depend on them."""
    from pyspark.sql import Window as W

    if min_words < PERIOD:
        raise ValueError(f"min_words must be at least {PERIOD}, the period of the cover")
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = n_buckets(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    prefix = min_words - PERIOD + 1
    sample = texts.mapInArrow(lambda it: _packed(it, prefix, buckets, True), _PACKED)
    shared = sample.groupBy("bucket").applyInArrow(_shared_ranks, "chunk long, kind int, docs binary, tied binary")
    flagged = checkpointed(shared.groupBy("chunk").applyInArrow(_flagged, "doc_id long").distinct())
    some = texts.join(small_or_shuffled(flagged), "doc_id", "left_semi").select("doc_id", "text")
    suffixes = some.mapInArrow(lambda it: _packed(it, min_words, buckets, False, bits), _PACKED)
    runs = suffixes.groupBy("bucket").applyInArrow(_sorted_bucket, "chunk long, kind int, docs binary, place binary, source binary, source_place binary")
    found = checkpointed(runs.groupBy("chunk").applyInArrow(lambda t: _passages(t, min_words), "doc_id long, b int, e int, source long, at int"))
    sure = _confirmed(some, found, min_words, bits)
    by = W.partitionBy("doc_id").orderBy("b", "e")
    sure = sure.withColumn("fresh", F.coalesce(F.col("b") > F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    sure = sure.withColumn("k", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = sure.groupBy("doc_id", "k").agg(F.min("b").alias("begin_word"), F.max("e").alias("end_word"), F.min_by("source", "b").alias("source_doc_id"))
    return spans.select("doc_id", "begin_word", "end_word", "source_doc_id")


_WORD = re.compile(r"\S+")


def _without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans; what stands before and after a cut stays as it is."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["b"]):
        out.append(text[at : words[s["b"]][0]])
        at = words[s["e"] - 1][1]
    out.append(text[at:])
    return "".join(out)


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with repeated spans cut from `text` (and `n_chars`, if there, counted anew); documents without a word left go; same columns."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("begin_word").alias("b"), F.col("end_word").alias("e"))).alias("spans"))
    name = other_names(docs, "spans_")["spans_"]
    spans = small_or_shuffled(checkpointed(spans.withColumnRenamed("spans", name)))
    joined = docs.join(spans, "doc_id", "left")
    at_text, at_n, at_spans = joined.columns.index("text"), joined.columns.index("n_chars") if "n_chars" in docs.columns else -1, joined.columns.index(name)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            spans = batch.column(at_spans).to_pylist()
            texts, counts, stays = batch.column(at_text).to_pylist(), batch.column(at_n).to_pylist() if at_n >= 0 else None, []
            for i, s in enumerate(spans):
                if s and texts[i] is not None:
                    texts[i] = _without(texts[i], s)
                    if counts:
                        counts[i] = len(texts[i])
                stays.append(not s or bool(texts[i].strip()))
            columns = list(batch.columns)
            columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            if counts:
                columns[at_n] = pa.array(counts, batch.schema.field(at_n).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stays))

    touched = joined.where(F.col(name).isNotNull()).mapInArrow(cut, joined.schema)
    kept = joined.where(F.col(name).isNull())
    return kept.unionByName(touched).select(*[F.col(f"`{c}`") for c in docs.columns])
