"""How queries are registered, and the inputs that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, values: str) -> DataFrame:
    """A fixture given as (VALUES ...) AS t(...), the same text in both engines."""
    return spark.sql(f"SELECT * FROM {values}")


def r8(c: Column | str, digits: int = 8) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher logits from embeddings: ten positions a sequence, the label as the observed token."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.expr("vec_id div 10").alias("seq_id"), F.expr("vec_id % 10").alias("pos"), F.col("label").alias("token_id"), (F.col("vec_id") % 17 != 3).alias("attn"), F.transform("embedding", lambda x: x.cast("double") * 20.0).alias("logits"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large fact table of positions from lineitem, with non-finite values and nulls of every kind."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("student"),
        F.col("l_orderkey").alias("seq_id"),
        F.col("l_linenumber").alias("pos"),
        F.expr("CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN double('NaN') WHEN l_linenumber = 6 AND l_quantity > 48 THEN double('Infinity') WHEN l_linenumber = 5 AND l_quantity = 9 THEN NULL ELSE l_extendedprice / 100000.0 - 0.02 END").alias("kld"),
        (F.col("l_discount") < 0.055).alias("top1"),
        (F.col("l_discount") < 0.085).alias("top5"),
        F.expr("CASE WHEN l_tax < 0.005 THEN NULL WHEN l_quantity = 13 THEN double('NaN') ELSE l_tax - 0.04 END").alias("delta_p"),
        F.expr("CASE WHEN l_quantity = 17 THEN double('Infinity') ELSE l_discount / 10 - 0.001 END").alias("floor_kld"),
    )


#: The same facts for the oracle; `ok`, `dok` and `fok` tell finite values, `k` and `f` are clipped.
FACTS = """
f0 AS (
  SELECT l_returnflag AS student, l_orderkey AS seq_id, l_linenumber AS pos,
    CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 AND l_quantity > 48 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 5 AND l_quantity = 9 THEN NULL ELSE l_extendedprice / 100000.0 - 0.02 END AS kld,
    l_discount < 0.055 AS top1, l_discount < 0.085 AS top5,
    CASE WHEN l_tax < 0.005 THEN NULL WHEN l_quantity = 13 THEN 'NaN'::DOUBLE ELSE l_tax - 0.04 END AS delta_p,
    CASE WHEN l_quantity = 17 THEN 'Infinity'::DOUBLE ELSE l_discount / 10 - 0.001 END AS floor_kld
  FROM lineitem),
facts AS (
  SELECT *, kld IS NOT NULL AND isfinite(kld) AS ok, delta_p IS NOT NULL AND isfinite(delta_p) AS dok, isfinite(floor_kld) AS fok,
    CASE WHEN kld IS NOT NULL AND isfinite(kld) THEN greatest(kld, 0) END AS k, CASE WHEN isfinite(floor_kld) THEN greatest(floor_kld, 0) END AS f
  FROM f0)"""


def kernel_sql(k: int, bits: tuple[int, ...] = (0,), bf16: bool = True) -> str:
    """The kernel in long form, one row per id, for the oracle: ends in table `s` (bits, vec_id, seq_id, pos, token_id, attn, kld, top1, top5, lse, lp_tail). 0 bits: the teacher itself."""
    stored = "round_even(lp0 / pow(2, floor(log2(abs(lp0))) - 7), 0) * pow(2, floor(log2(abs(lp0))) - 7)" if bf16 else "lp0"
    levels = ", ".join(f"({b})" for b in bits)
    return f"""
t AS (SELECT vec_id, vec_id // 10 AS seq_id, vec_id % 10 AS pos, label AS token_id, vec_id % 17 <> 3 AS attn, embedding AS e FROM embeddings),
tl AS (SELECT vec_id, unnest(range(0, len(e))) AS i, unnest(e)::DOUBLE * 20 AS x FROM t),
te AS (SELECT vec_id, m + ln(sum(exp(x - m))) AS lse FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM tl) GROUP BY vec_id, m),
tr AS (SELECT vec_id, i, x - lse AS lp0, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM tl JOIN te USING (vec_id)),
tk AS (SELECT vec_id, i, r, {stored} AS lp FROM tr WHERE r <= {k}),
sg AS (SELECT bits, vec_id, i, x, min(x) OVER w AS mn, (max(x) OVER w - min(x) OVER w) / (pow(2, bits) - 1) AS sc FROM tl, (VALUES {levels}) b(bits) WINDOW w AS (PARTITION BY bits, vec_id, i // 16)),
sl AS (SELECT bits, vec_id, i, CASE WHEN bits = 0 OR sc = 0 THEN x ELSE mn + round((x - mn) / sc) * sc END AS x FROM sg),
sm AS (SELECT *, max(x) OVER (PARTITION BY bits, vec_id) AS m, row_number() OVER (PARTITION BY bits, vec_id ORDER BY x DESC, i) AS r FROM sl),
se AS (SELECT bits, vec_id, m + ln(sum(exp(x - m))) AS lse, sum(x) AS sx, count(*) AS v FROM sm GROUP BY bits, vec_id, m),
h AS (SELECT bits, vec_id, sum(exp(lp) * (lp - (x - lse))) AS head, sum(x - lse) AS slq, least(ln(sum(exp(lp))), -1e-7) AS hs, max(CASE WHEN tk.r = 1 THEN sm.r END) AS place
  FROM tk JOIN sm USING (vec_id, i) JOIN se USING (bits, vec_id) GROUP BY bits, vec_id),
h2 AS (SELECT *, ln(1 - exp(hs)) - ln(v - {k}) AS lp_tail FROM h JOIN se USING (bits, vec_id)),
s AS (SELECT bits, vec_id, seq_id, pos, token_id, attn, lse, lp_tail, place = 1 AS top1, place <= 5 AS top5,
  head + exp(lp_tail) * ((v - {k}) * lp_tail - (sx - v * lse - slq)) AS kld FROM h2 JOIN t USING (vec_id))"""
