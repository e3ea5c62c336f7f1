"""Calibration corpora: rows of text or chat to fixed-length chunks of tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.errors import CorpusError
from driftquarry.functions import text


def read_corpus(spark: SparkSession, spec: str, fmt: str = "parquet") -> DataFrame:
    """Rows of path[:subset]; a subset is a folder of the path."""
    path, subset = spark.range(1).select(text.split_spec(F.lit(spec)).alias("s")).select("s.*").first()
    return spark.read.format(fmt).load(f"{path}/{subset}" if subset else path)


def corpus_texts(rows: DataFrame, order: str, template: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(row_idx, text) of rows that aren't blank, from the column `text`, else from rendered `messages`; order is kept as a column."""
    names = set(rows.columns)
    if "text" in names:
        found = rows.select(F.col(order).alias("row_idx"), "text")
    elif "messages" in names:
        if template is None:
            raise CorpusError("a chat corpus needs a template")
        found = rows.where(F.size("messages") > 0).select(F.col(order).alias("row_idx"), render_chat("messages", template).alias("text"))
    else:
        raise CorpusError(f"no text or messages among the columns {sorted(names)}")
    return found.where(text.nonblank("text"))


def render_chat(messages: str, template: Callable[[Column, Column], Column]) -> Column:
    return F.array_join(F.transform(messages, lambda m: template(m["role"], m["content"])), "")


def code_points(t: Column | str, vocab: int = 4096) -> Column:
    """A deterministic tokenizer for tests: one id per character."""
    c = F.col(t) if isinstance(t, str) else t
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) % vocab)


def words(t: Column | str) -> Column:
    """Lower-case runs of the letters a to z."""
    c = F.col(t) if isinstance(t, str) else t
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def with_offsets(rows: DataFrame, count: str, order: str = "row_idx", parts: int = 64) -> DataFrame:
    """Adds `before`, the running sum of `count` over all earlier rows, without sorting all rows in one task.

    Rows fall into parts between percentiles of the order; sums of parts (a handful) are put in order first, then
    each part adds its own. The percentiles are drawn once, so both passes see the same parts.
    """
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = sorted(set(rows.agg(F.percentile_approx(order, shares, 10_000)).first()[0] or []))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    ranged = rows.withColumn("part_", at)
    sums = ranged.groupBy("part_").agg(F.sum(count).alias("sum_"))
    base = sums.select("part_", (F.sum("sum_").over(W.orderBy("part_")) - F.col("sum_")).alias("base_"))
    own = F.coalesce(F.sum(count).over(W.partitionBy("part_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("own_", own).join(F.broadcast(base), "part_").withColumn("before", F.col("base_") + F.col("own_")).drop("part_", "own_", "base_")


def head_rows(rows: DataFrame, tokenize: Callable[[str], Column], threshold: int, order: str = "row_idx") -> DataFrame:
    """Rows in order with `tokens`, `n` and `before`, until `threshold` tokens are reached; the row that reaches it is the last.

    Only a head of the corpus is tokenised: the first rows in order (a distributed top-n), four times as many as long
    as they don't hold enough.
    """
    take = 256
    while True:
        head = rows.orderBy(order).limit(take).withColumn("tokens", tokenize("text")).withColumn("n", F.size("tokens"))
        got, total = head.agg(F.count("*"), F.sum("n")).first()
        if got < take or (total or 0) >= threshold:
            return with_offsets(head, "n", order).where(F.col("before") < threshold)
        take *= 4


def chunks(tokens: DataFrame, length: int) -> DataFrame:
    """(chunk, tokens): the concatenated stream of (before, tokens) cut into pieces of `length`; a shorter last piece is dropped."""
    flat = tokens.select("before", F.posexplode("tokens").alias("i", "token")).withColumn("at", F.col("before") + F.col("i"))
    piece = F.floor(F.col("at") / length).cast("long")
    out = flat.groupBy(piece.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("s"))
    return out.where(F.size("s") == length).select("chunk", F.col("s.token").alias("tokens"))


def sample_order(n: int, take: int, seed: int) -> list[int]:
    """Which of n chunks make up the sample, in order: a seeded permutation, the same wherever it is drawn."""
    return np.random.default_rng(seed).permutation(n)[:take].tolist()


def sampled(pieces: DataFrame, total: int, take: int, seed: int) -> DataFrame:
    """(seq_id, tokens): the seeded sample of chunks, in its own order."""
    if total < take:
        raise CorpusError(f"{total} chunks, but {take} samples are asked for: lower num_samples or max_seq_len, or use a longer corpus")
    order = pieces.sparkSession.createDataFrame(list(enumerate(sample_order(total, take, seed))), "seq_id int, chunk long")
    return pieces.join(F.broadcast(order), "chunk").select("seq_id", "tokens")


def calibration_chunks(rows: DataFrame, tokenize: Callable[[str], Column], samples: int, length: int, seed: int) -> DataFrame:
    """(seq_id, tokens): from texts in order to the sample. Only as many rows are used as twice the sample needs."""
    head = head_rows(rows, tokenize, 2 * (samples * length + length))
    total = (head.agg(F.sum("n")).first()[0] or 0) // length
    return sampled(chunks(head, length), total, samples, seed)


def stream_hash(sequences: DataFrame) -> str:
    """Sixteen hex digits over the ids as little-endian 32-bit integers, in order of sequence. Sequences may differ in length; one without ids, or an id that is null, is an error.

    Tasks pack their ranges of the order into bytes, and the driver hashes one range after the other: it holds one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids = lists.flatten()
            if lists.null_count or ids.null_count:
                raise ValueError("a token stream has an id that is null")
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(ids).astype("<i4").tobytes()], pa.binary())], names=["ids"])

    digest = hashlib.sha256()
    for (ids,) in sequences.orderBy("seq_id").select(F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(run, "ids binary").toLocalIterator():
        digest.update(ids)
    return digest.hexdigest()[:16]
