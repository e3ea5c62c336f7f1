"""Column expressions of the divergence kernel, for SQL plans: one row is one position, with logits as an array.

`arrow_kernel` has the same in numpy, which is what scoring runs.

All sums run in double precision inside the JVM. Every quantity that a lambda refers to (the maximum, the
log-sum-exp) is carried as an output column, so that the optimizer doesn't inline an O(V) expression into a
loop over V. Ties in any ranking of logits go to the lower id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest log-probability that the stored head may sum to; keeps the tail's logarithm finite.
HEAD_CAP = -1e-7


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def log1mexp(x: Column | str) -> Column:
    """ln(1 - e^x) for x < 0, by expm1 near zero and log1p far from it."""
    x = _c(x)
    return F.when(x > -float(np.log(2)), F.log(-F.expm1(F.least(x, F.lit(-1e-30))))).otherwise(F.log1p(-F.exp(x)))


def with_lse(df: DataFrame, logits: str = "logits", out: str = "lse") -> DataFrame:
    """Adds the log-sum-exp of the logits."""
    m = f"{out}_max"
    shifted = F.col(m) + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - F.col(m))))
    return df.withColumn(m, F.array_max(logits)).select("*", shifted.alias(out)).drop(m)


def log_softmax(logits: Column | str, lse: Column | str) -> Column:
    return F.transform(_c(logits), lambda x: x - _c(lse))


def bf16(x: Column | str) -> Column:
    """Rounding to bfloat16 (8 significant bits), half to even, as arithmetic on doubles; zero and non-finite values stay."""
    x = _c(x)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 7)
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.rint(x / unit) * unit)


def ranked(logits: Column | str, k: Column | int) -> Column:
    """The k largest as structs (n: negated value, i: id), largest first."""
    return F.slice(F.array_sort(F.transform(_c(logits), lambda x, i: F.struct((-x).alias("n"), i.alias("i")))), 1, k)


def clamp_k(k: Column | int, vocab: Column) -> Column:
    """K as the cache keeps it: less than the vocabulary's size."""
    return F.least(k if isinstance(k, Column) else F.lit(k), vocab - 1)


def argmax(logits: Column | str) -> Column:
    return (F.array_position(_c(logits), F.array_max(_c(logits))) - 1).cast("int")


def top_ids(logits: Column | str, k: int) -> Column:
    return F.transform(ranked(logits, k), lambda s: s["i"])


def tail_logp(head: Column, vocab: Column, k: Column) -> Column:
    """Log-probability of each id outside the head, the rest being spread evenly."""
    return log1mexp(F.least(head, F.lit(HEAD_CAP))) - F.log((vocab - k).cast("double"))


def with_kld(df: DataFrame, out: str = "kld") -> DataFrame:
    """Adds the divergence of `logits` (with `lse`) from the stored head (`topk_idx`, `topk_logp`) with an even tail.

    Over the tail only sums are needed: the log-probabilities of all ids are sum(logits) - V*lse, less the head's.
    A head as large as the vocabulary leaves no tail and is an error.
    """
    v, k = F.size("logits"), F.size("topk_idx")
    checked = df.withColumn("idx_", F.when(k < v, F.col("topk_idx")).otherwise(F.raise_error(F.lit("the head must be smaller than the vocabulary")).cast("array<int>")))
    step = checked.withColumn("lq_", F.transform("idx_", lambda i: F.element_at("logits", i + 1) - F.col("lse"))).withColumn("head_", F.log(F.aggregate("topk_logp", F.lit(0.0), lambda s, x: s + F.exp(x))))
    step = step.withColumn("tail_", tail_logp(F.col("head_"), v, k))
    head = total(F.zip_with("topk_logp", "lq_", lambda p, q: F.exp(p) * (p - q)))
    lq_tail = total("logits") - v * F.col("lse") - total("lq_")
    return step.withColumn(out, head + F.exp("tail_") * ((v - k) * F.col("tail_") - lq_tail)).drop("idx_", "lq_", "head_", "tail_")


def exact_kl(p_logits: str, p_lse: str, q_logits: str, q_lse: str) -> Column:
    """KL(p || q) over the whole vocabulary."""
    return total(F.zip_with(p_logits, q_logits, lambda p, q: F.exp(p - F.col(p_lse)) * ((p - F.col(p_lse)) - (q - F.col(q_lse)))))


def delta_p(token: Column) -> Column:
    """Student's less teacher's probability of `token`: the teacher's from its head if it is there, else an even share of the tail."""
    v, k = F.size("logits"), F.size("topk_idx")
    at = F.array_position("topk_idx", token).cast("int")
    head = F.log(F.aggregate("topk_logp", F.lit(0.0), lambda s, x: s + F.exp(x)))
    teacher = F.when(at > 0, F.exp(F.element_at("topk_logp", F.greatest(at, F.lit(1))))).otherwise(F.exp(tail_logp(head, v, k)))
    return F.when(token.isNotNull(), F.exp(F.element_at("logits", token + 1) - F.col("lse")) - teacher)


def quantised(logits: Column | str, bits: Column | int, group: int = 16) -> Column:
    """A stand-in student: values of each group of ids rounded to 2^bits levels between the group's ends."""
    a, levels = _c(logits), F.pow(F.lit(2.0), bits if isinstance(bits, Column) else F.lit(bits)) - 1

    def one(g: Column) -> Column:
        part = F.slice(a, g * group + 1, group)
        low, high = F.array_min(part), F.array_max(part)
        scale = (high - low) / levels
        return F.transform(part, lambda x: F.when(scale == 0, x).otherwise(low + F.round((x - low) / scale) * scale))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / group).cast("int") - 1), one))


def align_vocab(df: DataFrame, vocab: int, logits: str = "logits") -> DataFrame:
    """Logits as wide as the teacher's vocabulary, and `pad_mass`, the probability on the ids cut off. Narrower logits are an error."""
    wide = with_lse(df, logits, "full_")
    size = F.size(logits)
    cut = F.when(size < vocab, F.raise_error(F.concat(F.lit("student logits are narrower than the teacher's vocabulary: "), size.cast("string"))).cast("array<double>")).otherwise(F.slice(logits, 1, vocab))
    head = with_lse(wide.withColumn(logits, cut), logits, "kept_")
    return head.withColumn("pad_mass", F.when(F.col("full_") == F.col("kept_"), 0.0).otherwise(1 - F.exp(F.col("kept_") - F.col("full_")))).drop("full_", "kept_")
