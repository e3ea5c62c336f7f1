"""The divergence kernel in numpy over Arrow batches: what the library runs, at any vocabulary.

The expressions in `kernel` say the same for SQL plans, but interpret a lambda for each id; here a row of 150,000
logits is a few array operations. Rows are taken in slices of about `VALUES` numbers, so memory is bounded by a slice
and the Arrow batch. Sums are double precision; ties in any ranking of logits go to the lower id. A row without
logits or head has null results; rows of a batch may differ in their widths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import HEAD_CAP

#: Numbers of a slice, and of one whose logits are made within the worker; bytes of an Arrow batch.
VALUES, MADE, BATCH_BYTES = 4_000_000, 1_000_000, 64 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches by bytes, not only by rows: ten thousand rows of logits are gigabytes. A smaller bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > most:
        spark.conf.set(name, str(most))


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)


def _slices(batch: pa.RecordBatch, *names: str, most: int = 0) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, a matrix for each column) of rows whose lists are there and of equal lengths; `most` rows at a time, else as many as make a slice."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    shape = np.stack([_lengths(c) for c in columns], 1)
    there = np.flatnonzero((shape > 0).all(1))
    for lengths in np.unique(shape[there], axis=0) if len(there) else []:
        rows = there[(shape[there] == lengths).all(1)]
        step = most or max(1, VALUES // int(lengths.max()))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            taken = [c.slice(part[0], len(part)) if part[-1] - part[0] + 1 == len(part) else c.take(pa.array(part)) for c in columns]
            yield part, [np.asarray(t.flatten()).reshape(len(part), -1) for t in taken]


def logsumexp(x: np.ndarray) -> np.ndarray:
    m = x.max(1, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(1, keepdims=True)))[:, 0]


def top_ids(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k largest of each row, largest first; NaN last."""
    v = x.shape[1]
    if v <= 1024 or 2 * k > v:
        return np.argsort(-x, axis=1, kind="stable")[:, :k]
    out = np.empty((len(x), k), np.int64)
    for i, row in enumerate(x):
        least = np.partition(row, v - k)[v - k]
        among = np.flatnonzero(row >= least) if not np.isnan(row[-1] + least) and not np.isnan(row).any() else np.arange(v)
        out[i] = among[np.argsort(-row[among], kind="stable")][:k]
    return out


def bf16(x: np.ndarray) -> np.ndarray:
    """Rounded to 8 significant bits, half to even; zero and non-finite values stay."""
    safe = np.where(np.isfinite(x), x, 0.0)
    unit = np.exp2(np.frexp(safe)[1] - 8.0)
    return np.where(np.isfinite(x), np.rint(safe / unit) * unit, x)


def tail_logp(head: np.ndarray, rest: np.ndarray | int) -> np.ndarray:
    """Log-probability of each id outside a head of log-mass `head`, spread evenly over `rest` ids."""
    head = np.minimum(head, HEAD_CAP)
    return np.where(head > -np.log(2), np.log(-np.expm1(head)), np.log1p(-np.exp(np.minimum(head, -0.1)))) - np.log(rest)


def kld(mass: np.ndarray, term: np.ndarray, lq: np.ndarray, total: np.ndarray, vocab: int, k: np.ndarray | int) -> np.ndarray:
    """Divergence from sums over the head: `mass` of p, `term` of p (lp - lq), `lq`; and `total`, the sum of lq over all ids."""
    tail = tail_logp(np.log(mass), vocab - k)
    return term + np.exp(tail) * ((vocab - k) * tail - (total - lq))


def _checked(k: int, vocab: int) -> None:
    if k >= vocab:
        raise ValueError("the head must be smaller than the vocabulary")


def heads(x: np.ndarray, k: int, rounded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, log-probabilities, floors) of the stored form of rows of logits. K is clamped to V - 1."""
    v, lse = x.shape[1], logsumexp(x)
    top = top_ids(x, min(k, v - 1))
    lq = np.take_along_axis(x, top, 1) - lse[:, None]
    lp = bf16(lq) if rounded else lq
    p = np.exp(lp)
    floor = kld(p.sum(1), (p * (lp - lq)).sum(1), lq.sum(1), x.sum(1) - v * lse, v, top.shape[1]) if v > 1 else np.full(len(x), np.nan)
    return top, lp, floor


def teacher_topk(df: DataFrame, k: int, rounded: bool = True) -> DataFrame:
    """Replaces `logits` by the stored form: topk_idx, topk_logp (ranked before rounding), floor_kld. K is clamped to V - 1."""
    bound_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != "logits"]
    schema = T.StructType([*kept, T.StructField("topk_idx", T.ArrayType(T.IntegerType())), T.StructField("topk_logp", T.ArrayType(T.DoubleType())), T.StructField("floor_kld", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ids, values, floor = [None] * n, [None] * n, np.full(n, np.nan)
            for rows, (x,) in _slices(batch, "logits"):
                top, lp, floor[rows] = heads(x.astype(np.float64, copy=False), k, rounded)
                for r, i, value in zip(rows, top.astype(np.int32), lp):
                    ids[r], values[r] = i, value
            void = pa.array([i is None for i in ids], pa.bool_())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pc.if_else(void, pa.scalar(None, pa.float64()), pa.array(floor))], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in kept], "logits").mapInArrow(run, schema)


def compared(x: np.ndarray, idx: np.ndarray, lp: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kld, top1, top5, delta_p) of rows of a student's logits against stored heads; delta_p is NaN where `token`, the next one, is negative."""
    v, k = x.shape[1], idx.shape[1]
    _checked(k, v)
    lse, p = logsumexp(x), np.exp(lp)
    lq = np.take_along_axis(x, idx.astype(np.int64), 1) - lse[:, None]
    mass, shift = p.sum(1), np.full(len(x), np.nan)
    # The teacher's first id is among the top five if fewer than five ids rank before it.
    mine = np.take_along_axis(x, idx[:, :1].astype(np.int64), 1)
    five = (x > mine).sum(1) + ((x == mine) & (np.arange(v) < idx[:, :1])).sum(1) < 5
    at = np.flatnonzero(token >= 0)
    t = token[at]
    hit = idx[at] == t[:, None]
    teacher = np.where(hit.any(1), p[at, hit.argmax(1)], np.exp(tail_logp(np.log(mass[at]), v - k)))
    shift[at] = np.exp(x[at, t] - lse[at]) - teacher
    return kld(mass, (p * (lp - lq)).sum(1), lq.sum(1), x.sum(1) - v * lse, v, k), x.argmax(1) == idx[:, 0], five, shift


_SCORES = [T.StructField(n, t) for n, t in (("kld", T.DoubleType()), ("top1", T.BooleanType()), ("top5", T.BooleanType()), ("delta_p", T.DoubleType()))]


class _Scores:
    """What `compared` finds for the rows of a batch; null where a row has no logits or no head, delta_p also without a next token."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.token = np.asarray(pc.fill_null(pc.cast(batch.column(batch.schema.get_field_index("next_token")), pa.int64()), -1))
        self.numbers, self.found, self.known = np.full((2, n), np.nan), np.zeros((2, n), bool), np.zeros(n, bool)

    def put(self, rows: np.ndarray, x: np.ndarray, idx: np.ndarray, lp: np.ndarray) -> None:
        self.numbers[0, rows], self.found[0, rows], self.found[1, rows], self.numbers[1, rows] = compared(x.astype(np.float64, copy=False), idx, lp.astype(np.float64, copy=False), self.token[rows])
        self.known[rows] = True

    def columns(self) -> list[pa.Array]:
        null, known = pa.scalar(None, pa.float64()), pa.array(self.known)
        shifted = pa.array(self.known & (self.token >= 0))
        return [pc.if_else(known, pa.array(self.numbers[0]), null), *[pc.if_else(known, pa.array(f), pa.scalar(None, pa.bool_())) for f in self.found], pc.if_else(shifted, pa.array(self.numbers[1]), null)]


def scored(joined: DataFrame, carried: list[str]) -> DataFrame:
    """(carried..., kld, top1, top5, delta_p) of rows with topk_idx, topk_logp, logits and next_token (null where no shift is asked for)."""
    bound_batches(joined.sparkSession)
    schema = T.StructType([*[joined.schema[c] for c in carried], *_SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _Scores(batch)
            for rows, (x, idx, lp) in _slices(batch, "logits", "topk_idx", "topk_logp"):
                scores.put(rows, x, idx, lp)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carried], *scores.columns()], names=schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in carried], "topk_idx", "topk_logp", "logits", "next_token").mapInArrow(run, schema)


def scored_made(joined: DataFrame, carried: list[str], k: int, vocab: int, teacher: Callable[[np.ndarray], np.ndarray], student: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(carried..., kld, top1, top5, delta_p, floor_kld) as by `teacher_topk` and `scored`, of rows with teacher_input, student_input and next_token.

    Two functions make logits of `vocab` ids from rows of inputs, some rows at a time: logits and heads never leave the worker.
    """
    bound_batches(joined.sparkSession)
    schema = T.StructType([*[joined.schema[c] for c in carried], *_SCORES, T.StructField("floor_kld", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, floor = _Scores(batch), np.full(batch.num_rows, np.nan)
            for rows, (a, b) in _slices(batch, "teacher_input", "student_input", most=max(1, MADE // vocab)):
                top, lp, floor[rows] = heads(teacher(a), k)
                scores.put(rows, student(b), top, lp)
            floors = pc.if_else(pa.array(scores.known), pa.array(floor), pa.scalar(None, pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carried], *scores.columns(), floors], names=schema.names)

    return joined.select(*[F.col(f"`{c}`") for c in carried], "teacher_input", "student_input", "next_token").mapInArrow(run, schema)


def floor_sums(logits: DataFrame, ks: list[int], vocab: int = 0, made: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(k, total, most, n): sum and maximum of clipped floors by K, of each Arrow batch. One ranking serves all K: sums over its prefixes are cumulative sums.

    With `made` the column has inputs, from which that function makes logits of `vocab` ids within the worker.
    """
    bound_batches(logits.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(ks)
        for batch in batches:
            if not batch.num_rows:
                continue
            total, most = np.zeros(len(ks)), np.full(len(ks), -np.inf)
            seen = 0
            for rows, (x,) in _slices(batch, "logits", most=max(1, MADE // vocab) if made else 0):
                x = (made(x) if made else x).astype(np.float64, copy=False)
                v, lse = x.shape[1], logsumexp(x)
                _checked(int(at[-1]), v)
                lq = np.take_along_axis(x, top_ids(x, int(at[-1])), 1) - lse[:, None]
                lp = bf16(lq)
                p = np.exp(lp)
                sums = [np.cumsum(a, 1)[:, at - 1] for a in (p, p * (lp - lq), lq)]
                floor = np.maximum(kld(*sums, (x.sum(1) - v * lse)[:, None], v, at), 0)
                total, most, seen = total + floor.sum(0), np.maximum(most, floor.max(0)), seen + len(rows)
            if seen < batch.num_rows:  # a position without logits shows
                total, most = total + np.nan, most + np.nan
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total), pa.array(most), pa.array(np.full(len(ks), batch.num_rows))], names=["k", "total", "most", "n"])

    return logits.select("logits").mapInArrow(run, "k int, total double, most double, n long")
