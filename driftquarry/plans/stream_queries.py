"""Streams give what batches give."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftquarry.functions import text
from driftquarry.operators import aggregate
from driftquarry.sources import corpus
from driftquarry.streaming import metrics

from .base import FACTS, facts, query, r8, table


@query("st1_stream_ingest", "SELECT doc_id AS row_idx, len(regexp_extract_all(lower(text), '[a-z]+'))::INT AS n FROM documents WHERE regexp_matches(text, '\\S')")
def st1(spark, d):
    where = metrics.scratch(spark)
    n = metrics.staged(table(spark, d, "documents"), f"{where}/in")
    rows = metrics.available(spark, f"{where}/in", n).where(text.nonblank("text")).select(F.col("doc_id").alias("row_idx"), F.size(corpus.words("text")).alias("n"))
    metrics.accumulate(rows, f"{where}/rows", f"{where}/state")
    return metrics.accumulated(spark, f"{where}/rows")


@query("st3_online_metrics", f"WITH {FACTS} SELECT student, count(*) FILTER (WHERE ok) AS tokens_scored, round(avg(k), 7) AS mean, round(quantile_cont(k, 0.99), 7) AS p99 FROM facts GROUP BY student")
def st3(spark, d):
    where = metrics.scratch(spark)
    n = metrics.staged(facts(spark, d), f"{where}/in")
    metrics.accumulate(metrics.available(spark, f"{where}/in", n), f"{where}/facts", f"{where}/state")
    out = aggregate.scalars(metrics.accumulated(spark, f"{where}/facts"), ("student",), {"p99": 0.99})
    return out.select("student", "tokens_scored", r8("mean", 7).alias("mean"), r8("p99", 7).alias("p99"))


@query("st4_alarm", "SELECT min(l_linenumber)::INT AS first_batch, max(l_tax) AS worst FROM lineitem WHERE l_linenumber = (SELECT min(l_linenumber) FROM lineitem WHERE l_tax > 0.05)")
def st4(spark, d):
    """One batch a line number, in order; the first with too much padded mass raises the alarm."""
    where, seen = metrics.scratch(spark), []
    rows = table(spark, d, "lineitem").select("l_linenumber", F.col("l_tax").alias("pad_mass"))
    for i in range(1, 8):  # the stream takes files in order of their age
        rows.where(F.col("l_linenumber") == i).coalesce(1).write.mode("append").parquet(f"{where}/in")
    metrics.accumulate(metrics.available(spark, f"{where}/in"), f"{where}/facts", f"{where}/state", lambda n, worst: seen.append((n + 1, worst)), 0.05)
    return spark.createDataFrame(seen, "first_batch int, worst double")
