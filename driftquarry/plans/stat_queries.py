"""Queries of the statistics over fact tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftquarry.functions import text
from driftquarry.operators import aggregate

from .base import FACTS, facts, inline, query, r8, table

BUCKETS = aggregate.Buckets(1, 7)
_BUCKET_SQL = "CASE WHEN pos >= 4 THEN 3 WHEN pos = 3 THEN 2 WHEN pos = 2 THEN 1 WHEN pos = 1 THEN 0 END"
_SE = """SELECT student, sqrt(count(*) / (count(*) - 1.0) * sum(r * r) / (sum(n) * sum(n)::DOUBLE)) AS se, count(*) AS g, sum(n)::BIGINT AS n FROM (
  SELECT student, seq_id, sum({v} - m) AS r, count(*) AS n FROM (SELECT *, avg({v}) OVER (PARTITION BY student) AS m FROM facts WHERE {ok}) GROUP BY student, seq_id) GROUP BY student"""


def _scalars(spark, d, **shares):
    return aggregate.scalars(facts(spark, d), ("student",), shares)


@query("a1_counts", f"WITH {FACTS} SELECT student, count(*) FILTER (WHERE ok) AS tokens_scored, count(*) FILTER (WHERE NOT ok) AS tokens_dropped_nonfinite FROM facts GROUP BY student")
def a1(spark, d):
    return _scalars(spark, d).select("student", "tokens_scored", "tokens_dropped_nonfinite")


@query("a2_mean_max", f"WITH {FACTS} SELECT student, round(avg(k), 7) AS mean, round(max(k), 7) AS max FROM facts GROUP BY student")
def a2(spark, d):
    return _scalars(spark, d).select("student", r8("mean", 7).alias("mean"), r8("max", 7).alias("max"))


@query("a3_quantiles", f"WITH {FACTS} SELECT student, round(quantile_cont(k, 0.5), 7) AS p50, round(quantile_cont(k, 0.95), 7) AS p95, round(quantile_cont(k, 0.99), 7) AS p99, round(quantile_cont(k, 0.999), 7) AS p999 FROM facts WHERE ok GROUP BY student")
def a3(spark, d):
    return _scalars(spark, d, **aggregate.SHARES).select("student", *[r8(c, 7).alias(c) for c in ("p50", "p95", "p99", "p999")])


@query("a4_clustered_se", f"WITH {FACTS} SELECT student, round(se, 8) AS se, g AS clusters, n FROM ({_SE.format(v='k', ok='ok')})")
def a4(spark, d):
    values = facts(spark, d).where(aggregate.finite("kld")).withColumn("k", aggregate.clipped("kld"))
    return aggregate.clustered_se(values, "k", "seq_id", ("student",)).select("student", r8("se").alias("se"), "clusters", "n")


@query(
    "a5_iid_se",
    f"""WITH {FACTS},
g AS (SELECT student, k, ok, CASE WHEN student = 'N' AND pos = 7 THEN NULL ELSE seq_id END AS seq_id FROM facts),
m AS (SELECT *, avg(k) OVER (PARTITION BY student) AS m FROM g WHERE ok),
c AS (SELECT student, sqrt(count(*) / (count(*) - 1.0) * sum(r * r) / (sum(n) * sum(n)::DOUBLE)) AS se FROM (SELECT student, seq_id, sum(k - m) AS r, count(*) AS n FROM m GROUP BY ALL) GROUP BY student),
i AS (SELECT student, stddev_samp(k) / sqrt(count(k)) AS se, count(*) FILTER (WHERE seq_id IS NULL) AS gaps FROM g GROUP BY student)
SELECT student, round(CASE WHEN gaps > 0 THEN i.se ELSE c.se END, 8) AS se, CASE WHEN gaps > 0 THEN 'iid' ELSE 'clustered-by-sequence' END AS se_method FROM i JOIN c USING (student)""",
)
def a5(spark, d):
    gaps = facts(spark, d).withColumn("seq_id", F.when(~((F.col("student") == "N") & (F.col("pos") == 7)), F.col("seq_id")))
    return aggregate.summarize(gaps).select("student", r8("se").alias("se"), "se_method")


@query("a6_delta_p_stats", f"WITH {FACTS} SELECT student, round(avg(delta_p) FILTER (WHERE dok), 8) + 0.0 AS mean, round(any_value(se), 8) AS se, round(sqrt(avg(delta_p * delta_p) FILTER (WHERE dok)), 8) AS rms FROM facts JOIN ({_SE.format(v='delta_p', ok='dok')}) USING (student) GROUP BY student")
def a6(spark, d):
    return aggregate.summarize(facts(spark, d)).select("student", r8("delta_p_mean").alias("mean"), r8("delta_p_se").alias("se"), r8("delta_p_rms").alias("rms"))


@query(
    "a7_by_position",
    f"""WITH {FACTS}, b(bucket, range) AS (VALUES (0, '1-2'), (1, '2-3'), (2, '3-4'), (3, '4-end'))
SELECT student, range, count(k) AS tokens, round(avg(k), 7) AS mean_kld, round(quantile_cont(k, 0.95), 7) AS p95_kld, round(avg(top1::INT), 7) AS top1_agreement
FROM (SELECT DISTINCT student FROM facts) s CROSS JOIN b LEFT JOIN (SELECT *, {_BUCKET_SQL} AS bucket FROM facts WHERE ok) f USING (student, bucket) GROUP BY student, range""",
)
def a7(spark, d):
    return aggregate.by_position(facts(spark, d), BUCKETS, ("student",)).select("student", "range", "tokens", *[r8(c, 7).alias(c) for c in ("mean_kld", "p95_kld", "top1_agreement")])


@query("a8_bucket_dim", "SELECT start, i, start + i * q AS lo, CASE WHEN i < 3 THEN start + (i + 1) * q END AS hi, CASE WHEN i < 3 THEN (start + i * q) || '-' || (start + (i + 1) * q) ELSE (start + i * q) || '-end' END AS label FROM (SELECT s AS start, (greatest(e - s, 4) // 4)::INT AS q FROM (VALUES (256, 512), (4, 8), (0, 2), (2, 6)) t(s, e)), (VALUES (0), (1), (2), (3)) b(i)")
def a8(spark, d):
    rows = [(s, i, lo, hi, label) for s, e in ((256, 512), (4, 8), (0, 2), (2, 6)) for i, lo, hi, label in aggregate.Buckets(s, e).rows()]
    return spark.createDataFrame(rows, "start int, i int, lo int, hi int, label string")


@query(
    "a9_histogram",
    f"""WITH {FACTS}, e AS (SELECT i::INT AS bin, CASE WHEN i = 0 THEN 0.0 ELSE pow(10, -6 + 7 * (i - 1) / 28.0) END AS lo, CASE WHEN i = 29 THEN 'Infinity'::DOUBLE ELSE pow(10, -6 + 7 * i / 28.0) END AS hi FROM range(30) r(i))
SELECT student, bin, count(k) AS n FROM (SELECT DISTINCT student FROM facts) CROSS JOIN e LEFT JOIN (SELECT student, k FROM facts WHERE ok) USING (student) WHERE true AND (k >= lo AND k < hi) GROUP BY ALL
UNION ALL SELECT student, bin, 0 FROM (SELECT DISTINCT student FROM facts) s CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.ok AND f.student = s.student AND f.k >= lo AND f.k < hi)""",
)
def a9(spark, d):
    return aggregate.histogram(facts(spark, d), ("student",)).select("student", "bin", "n")


@query("a10_rates", f"WITH {FACTS} SELECT student, round(avg(top1::INT) FILTER (WHERE ok), 8) AS top1, round(avg(top5::INT) FILTER (WHERE ok), 8) AS top5 FROM facts GROUP BY student")
def a10(spark, d):
    return _scalars(spark, d).select("student", r8("top1").alias("top1"), r8("top5").alias("top5"))


@query("a11_floor_mean", f"WITH {FACTS} SELECT student, CASE WHEN count(*) FILTER (WHERE g IS NULL) = 0 THEN round(avg(f), 8) END AS floor_mean FROM (SELECT *, CASE WHEN student = 'A' AND pos = 6 THEN NULL ELSE floor_kld END AS g FROM facts) GROUP BY student")
def a11(spark, d):
    gaps = facts(spark, d).withColumn("floor_kld", F.when(~((F.col("student") == "A") & (F.col("pos") == 6)), F.col("floor_kld")))
    return aggregate.scalars(gaps, ("student",), {}).select("student", r8("floor_mean").alias("floor_mean"))


@query("a12_empty", "SELECT 0::BIGINT AS tokens_scored, count(*) AS tokens_dropped_nonfinite, NULL::DOUBLE AS mean, NULL::DOUBLE AS p50, NULL::DOUBLE AS top1, NULL::DOUBLE AS se FROM lineitem")
def a12(spark, d):
    lost = facts(spark, d).withColumn("kld", F.lit(float("nan")))
    return aggregate.summarize(lost, ()).select("tokens_scored", "tokens_dropped_nonfinite", "mean", "p50", "top1", "se")


@query("pf6_nonfinite", f"WITH {FACTS} SELECT student, count(*) FILTER (WHERE kld IS NULL) AS nulls, count(*) FILTER (WHERE isnan(kld)) AS nans, count(*) FILTER (WHERE isinf(kld)) AS infinite, count(*) FILTER (WHERE ok) AS finite FROM facts GROUP BY student")
def pf6(spark, d):
    f = facts(spark, d)
    return f.groupBy("student").agg(F.count_if(F.col("kld").isNull()).alias("nulls"), F.count_if(F.isnan("kld")).alias("nans"), F.count_if(F.abs("kld") == float("inf")).alias("infinite"), F.count_if(aggregate.finite("kld")).alias("finite"))


@query("pf7_finite_populations", f"WITH {FACTS} SELECT ok AS kld_ok, dok AS delta_ok, fok AS floor_ok, count(*) AS n FROM facts GROUP BY ALL")
def pf7(spark, d):
    return facts(spark, d).groupBy(aggregate.finite("kld").alias("kld_ok"), aggregate.finite("delta_p").alias("delta_ok"), aggregate.finite("floor_kld").alias("floor_ok")).agg(F.count("*").alias("n"))


@query("pf8_clip", f"WITH {FACTS} SELECT student, count(*) FILTER (WHERE kld < 0) AS clipped, round(sum(k), 5) AS total, round(min(k), 8) AS low FROM facts WHERE ok GROUP BY student")
def pf8(spark, d):
    f = facts(spark, d).where(aggregate.finite("kld"))
    return f.groupBy("student").agg(F.count_if(F.col("kld") < 0).alias("clipped"), r8(F.sum(aggregate.clipped("kld")), 5).alias("total"), r8(F.min(aggregate.clipped("kld"))).alias("low"))


_FLAGS = "(VALUES (1, 0.0048, 0.0018, 0.97, 100), (2, 0.0036, 0.0018, 0.5, 100), (3, 0.0035, 0.0018, 0.4999, 100), (4, 1.0, 0.0, 0.6, 100), (5, 1.25, NULL, 0.25, 100), (6, NULL, 0.002, NULL, 0), (7, 0.001, -0.5, 0.99, 7)) AS t(id, mean, floor_mean, top1, tokens_scored)"
_FLAGGED = "SELECT id, mean::DOUBLE AS mean, floor_mean::DOUBLE AS floor_mean, top1::DOUBLE AS top1, tokens_scored FROM " + _FLAGS


def _flags(spark):
    return inline(spark, _FLAGS).select("id", *[F.col(c).cast("double").alias(c) for c in ("mean", "floor_mean", "top1")], "tokens_scored")


@query("pf21_floor_limited", f"SELECT id, coalesce(floor_mean > 0 AND mean < 2 * floor_mean, false) AS floor_limited FROM ({_FLAGGED})")
def pf21(spark, d):
    return _flags(spark).select("id", aggregate.floor_limited().alias("floor_limited"))


@query("pf22_implausible", f"""SELECT id, nullif(concat_ws('; ', CASE WHEN tokens_scored = 0 THEN 'nothing could be scored' END, CASE WHEN top1 < 0.5 THEN 'top-1 agreement ' || printf('%.2f%%', top1 * 100) || ' is below 50%' END,
CASE WHEN mean > 1 THEN 'mean divergence ' || printf('%.3f', mean) || ' is above 1.0' END), '') AS reason FROM ({_FLAGGED})""")
def pf22(spark, d):
    return _flags(spark).select("id", aggregate.implausible().alias("reason"))


@query("w5_seq_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)::BIGINT - 1 AS seq_id FROM orders")
def w5(spark, d):
    from driftquarry.sources import corpus

    rows = table(spark, d, "orders").select("o_orderkey").withColumn("one", F.lit(1))
    return corpus.with_offsets(rows, "one", "o_orderkey").select("o_orderkey", F.col("before").alias("seq_id"))


@query("w6_position", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::INT - 1 AS pos FROM lineitem")
def w6(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("pos"))


@query("u2_union_batches", f"WITH {FACTS} SELECT count(*) AS n, round(sum(k), 5) AS total FROM facts")
def u2(spark, d):
    f = facts(spark, d)
    parts = f.where("pos IS NULL")
    for k in range(7):
        parts = parts.unionByName(f.where(f"pmod(pos, 7) = {k}"))
    return parts.agg(F.count("*").alias("n"), r8(F.sum(F.when(aggregate.finite("kld"), aggregate.clipped("kld"))), 5).alias("total"))


@query("sc5_pruned_scan", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linenumber >= 4 AND l_linenumber < 6")
def sc5(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber >= 4 AND l_linenumber < 6").select("l_orderkey", "l_linenumber", "l_extendedprice")


_NUM = "(VALUES (1, 0.1234567, 0.00004, 3100000000), (2, 0.00001, 0.000003, 512), (3, -0.000003, NULL, 999), (4, 0.0, 0.5, 1000), (5, NULL, 0.1, 123456789), (6, 12.3456, 1.27e-7, 5500000000000), (7, 0.00004, 0.00006, 999500000)) AS t(id, m, s, n)"
_NUMS = f"SELECT id, m::DOUBLE AS m, s::DOUBLE AS s, n::BIGINT AS n FROM {_NUM}"


def _fixed_sql(x: str, digits: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' WHEN {x} <> 0 AND abs({x}) < 0.5 * pow(10, -{digits}) THEN printf('%.1e', {x}) ELSE printf('%.{digits}f', {x}) END"


def _numbers(spark):
    return inline(spark, _NUM).select("id", F.col("m").cast("double").alias("m"), F.col("s").cast("double").alias("s"), F.col("n").cast("bigint").alias("n"))


@query("f1_fmt", f"SELECT id, {_fixed_sql('m', 4)} AS four, {_fixed_sql('m', 5)} AS five, CASE WHEN m IS NULL THEN 'n/a' WHEN s IS NULL THEN {_fixed_sql('m', 4)} ELSE {_fixed_sql('m', 4)} || ' +/- ' || {_fixed_sql('s', 4)} END AS pm FROM ({_NUMS})")
def f1(spark, d):
    return _numbers(spark).select("id", text.fixed("m").alias("four"), text.fixed("m", 5).alias("five"), text.plus_minus("m", "s").alias("pm"))


@query("f2_pct_pp", f"SELECT id, CASE WHEN m IS NULL THEN 'n/a' ELSE printf('%.2f%%', m * 100) END AS pct, CASE WHEN m IS NULL THEN 'n/a' ELSE ({_fixed_sql('(m * 100.0::DOUBLE)', 3)}) || '%' END AS pp, CASE WHEN n >= 1e9 THEN printf('%.2fB', n / 1e9) ELSE printf('%.0fM', n / 1e6) END AS params FROM ({_NUMS})")
def f2(spark, d):
    return _numbers(spark).select("id", text.percent("m").alias("pct"), text.points("m").alias("pp"), text.parameters("n").alias("params"))


@query("f3_fmt_kinds", f"SELECT id, printf('%.2f GB', n / 1e9) AS gb, CASE WHEN m IS NULL THEN 'n/a' ELSE printf('%.3f', m) END AS bpw, {_fixed_sql('m', 4)} AS kld, n::VARCHAR AS auto FROM ({_NUMS})")
def f3(spark, d):
    return _numbers(spark).select("id", text.cell("n", "gb").alias("gb"), text.cell("m", "bpw").alias("bpw"), text.cell("m", "kld").alias("kld"), text.cell("n", "auto").alias("auto"))


@query("f4_human_bytes", f"SELECT id, CASE WHEN n < 1e3 THEN n::VARCHAR || ' B' WHEN n < 1e6 THEN printf('%.1f KB', n / 1e3) WHEN n < 1e9 THEN printf('%.1f MB', n / 1e6) WHEN n < 1e12 THEN printf('%.1f GB', n / 1e9) ELSE printf('%.1f TB', n / 1e12) END AS size FROM ({_NUMS})")
def f4(spark, d):
    return _numbers(spark).select("id", text.human_bytes("n").alias("size"))


@query("f9_thousands", f"SELECT id, format('{{:,}}', n) AS n FROM ({_NUMS})")
def f9(spark, d):
    return _numbers(spark).select("id", F.format_number("n", 0).alias("n"))


@query("k15_size_estimate", "SELECT n, l, k, (n * l * (6 * k + 9))::BIGINT AS bytes FROM (VALUES (512::BIGINT, 512::BIGINT, 512::BIGINT), (512, 512, 32768), (128, 256, 8192)) t(n, l, k)")
def k15(spark, d):
    from driftquarry.operators import cache_admin

    t = spark.sql("SELECT * FROM VALUES (512L, 512L, 512L), (512L, 512L, 32768L), (128L, 256L, 8192L) AS t(n, l, k)")
    return t.select("n", "l", "k", cache_admin.entry_bytes(F.col("n"), F.col("l"), F.col("k")).alias("bytes"))
