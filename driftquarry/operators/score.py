"""From stored heads and student logits to the fact table of positions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.functions import arrow_kernel


def _met(teacher: DataFrame, students: DataFrame, window: tuple[int, int] | None, keys: tuple[str, ...]) -> DataFrame:
    """Teacher's rows with next_token (null where it is masked), joined with the students' within the window."""
    by_seq = W.partitionBy("seq_id").orderBy("pos")
    ahead = teacher.select("*", F.lead("token_id").over(by_seq).alias("next_token"), F.coalesce(F.lead("attn").over(by_seq), F.lit(False)).alias("next_attn"))
    if window:
        inside = (F.col("pos") >= window[0]) & (F.col("pos") < window[1])
        ahead, students = ahead.where(inside), students.where(inside)
    return ahead.where("attn").join(students, list(keys)).withColumn("next_token", F.when(F.col("next_attn"), F.col("next_token")))


def score_student(teacher: DataFrame, students: DataFrame, window: tuple[int, int] | None = None, keys: tuple[str, ...] = ("seq_id", "pos")) -> DataFrame:
    """Positions (student columns, seq_id, pos, kld, top1, top5, delta_p, floor_kld) within the half-open window.

    `teacher`: seq_id, pos, token_id, attn, topk_idx, topk_logp, floor_kld; `students`: seq_id, pos, logits and any
    columns that name the student. The next token and its mask come from the teacher's rows before the window is
    applied, so the last scored position still sees its successor. One exchange by sequence serves the
    window function and the join; the filter on positions comes after both but is pushed to the students' scan.
    """
    named = [c for c in students.columns if c not in (*keys, "logits")]
    facts = arrow_kernel.scored(_met(teacher, students, window, keys), [*named, *keys, "floor_kld"])
    return facts.select(*named, *keys, "kld", "top1", "top5", "delta_p", "floor_kld")


def score_made(teacher: DataFrame, students: DataFrame, k: int, vocab: int, made: tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]], window: tuple[int, int] | None = None, keys: tuple[str, ...] = ("seq_id", "pos")) -> DataFrame:
    """What `score_student` gives, where `made` makes the teacher's and the students' logits from rows of inputs.

    `teacher`: seq_id, pos, token_id, attn, teacher_input; `students`: seq_id, pos, student_input and any columns that name
    the student. Only inputs are shuffled. They are spread over the shuffle partitions, as a row's work is far larger than the row;
    where the join has that partitioning already, Spark leaves this out and may merge small partitions.
    """
    spark = teacher.sparkSession
    named = [c for c in students.columns if c not in (*keys, "student_input")]
    met = _met(teacher, students, window, keys).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    facts = arrow_kernel.scored_made(met, [*named, *keys], k, vocab, *made)
    return facts.select(*named, *keys, "kld", "top1", "top5", "delta_p", "floor_kld")


def pad_mass_alarm(batches: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """(max_pad_mass, first_batch): the largest padded mass, NaN if any is, and the first batch that is not below the threshold."""
    return batches.agg(F.max("pad_mass").alias("max_pad_mass"), F.min(F.when(~(F.col("pad_mass") <= threshold) | F.isnan("pad_mass"), F.col("batch"))).alias("first_batch"))
