"""The reconstruction floor for many head sizes from one pass over the logits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.functions import arrow_kernel


def usable_k(ks: list[int], vocab: int) -> list[int]:
    return sorted({k for k in ks if 0 < k < vocab})


def floor_sweep(logits: DataFrame, ks: list[int], vocab: int, window: tuple[int, int] | None = None, made: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(k, mean_floor, max_floor, n, place, is_lowest, rises_again): logits are ranked once, each K takes a prefix of the ranking.

    The mean is over all positions, finite or not, as one bad position should show. Ties go to the smaller K. `made`
    makes rows of logits from what `logits` then holds, within the worker.
    """
    rows = logits.where((F.col("pos") >= window[0]) & (F.col("pos") < window[1])) if window else logits
    used = usable_k(ks, vocab)
    if not used:
        raise ValueError(f"no K lies between 0 and the vocabulary's size of {vocab}")
    sums = arrow_kernel.floor_sums(rows, used, vocab, made)
    stats = sums.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("mean_floor"), F.max("most").alias("max_floor"), F.sum("n").alias("n"))
    placed = stats.withColumn("place", F.row_number().over(W.orderBy("mean_floor", "k")))
    best = F.max(F.when(F.col("place") == 1, F.col("k"))).over(W.partitionBy())
    return placed.withColumn("is_lowest", F.col("place") == 1).withColumn("rises_again", F.col("k") > best)
