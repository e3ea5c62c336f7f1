"""Exact statistics of a fact table of positions, for any number of students at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper ends of histogram bins: 0, then 29 points from 1e-6 to 10 in even steps of the logarithm, then infinity.
EDGES = [0.0, *[10 ** (-6 + 7 * i / 28) for i in range(29)], float("inf")]


def finite(c: str | Column) -> Column:
    """True for numbers; false for null, NaN and infinities. The logarithm of nothing is null in SQL, so null counts as non-finite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clipped(c: str | Column) -> Column:
    """Negative rounding noise is zero. Only for finite values: greatest() would turn a null into a perfect score."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(c, F.lit(0.0))


def clustered_se(values: DataFrame, value: str, cluster: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, clusters, se): cluster-robust standard error of the mean, with the factor G / (G - 1).

    Two passes: the mean first, then the residual sums of clusters; a one-pass form would cancel where the mean is
    large against the spread. Null below two values or two clusters; zero where no residual is left.
    """
    mean = values.groupBy(*by).agg(F.avg(value).alias("mean_"))
    joined = values.join(F.broadcast(mean), list(by)) if by else values.crossJoin(F.broadcast(mean))
    sums = joined.groupBy(*by, cluster).agg(F.sum(F.col(value) - F.col("mean_")).alias("r_"), F.count(value).alias("n_"))
    out = sums.groupBy(*by).agg(F.sum("n_").alias("n"), F.count("*").alias("clusters"), F.sum(F.col("r_") * F.col("r_")).alias("ss_"))
    g, n = F.col("clusters"), F.col("n")
    return out.withColumn("se", F.when((n >= 2) & (g >= 2), F.sqrt(g / F.nullif(g - 1, F.lit(0)) * F.col("ss_") / (n * n)))).drop("ss_")


@dataclass(frozen=True)
class Buckets:
    """Quarters of the score window by position; the last has no upper end. Windows below four positions leave later buckets empty."""

    start: int
    end: int

    def rows(self) -> list[tuple[int, int, int | None, str]]:
        quarter = max(self.end - self.start, 4) // 4
        cuts = [self.start + i * quarter for i in range(4)]
        return [(i, low, cuts[i + 1] if i < 3 else None, f"{low}-{cuts[i + 1] if i < 3 else 'end'}") for i, low in enumerate(cuts)]

    def column(self, pos: str = "pos") -> Column:
        out = None
        for i, low, high, _ in self.rows():
            inside = (F.col(pos) >= low) & (F.lit(True) if high is None else F.col(pos) < high)
            out = F.when(inside, i) if out is None else out.when(inside, i)
        return out


#: Parts of an e-fold that the first histogram of `quantiles` tells apart, and of each of its bins the second does.
FOLD, FINE = 64, 1 << 16


def quantiles(values: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., q_): exact quantiles of non-negative finite values, interpolated linearly between neighbours, as an array in order of `shares`.

    No task holds a group's values. A histogram on the logarithm tells in which of its bins the wanted ranks lie, a
    second one of those bins (by even parts between a bin's least and greatest value) narrows them down, and only values of
    the few bins that are left are ranked, each distinct value once with its count. Three scans, shuffles of counts
    only; both bin functions never fall as values rise, so ranks add up over bins. Joined sides marked for broadcast
    have two rows for each group and share.
    """
    by, x = [*by], F.col("x_")
    grouped = values.select(*by, F.col(value).alias("x_"), F.when(F.col(value) > 0, F.floor(F.log(F.col(value)) * FOLD)).otherwise(-(1 << 40)).alias("b1_"))

    def placed(counts: DataFrame, parts: list[str], column: str, n: str) -> DataFrame:
        """Counts with how many values of the same part lie in earlier bins."""
        before = F.sum(n).over(_over(parts).orderBy(column).rowsBetween(W.unboundedPreceding, -1))
        return counts.withColumn("from_", F.coalesce(before, F.lit(0)))

    first = placed(grouped.groupBy(*by, "b1_").agg(F.count("*").alias("n_"), F.min("x_").alias("low_"), F.max("x_").alias("high_")), by, "b1_", "n_")
    first = first.withColumn("all_", F.sum("n_").over(_over(by)))
    at = [(F.col("all_") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array(*[F.struct(F.lit(2 * i + side).alias("name"), (F.ceil(h) if side else F.floor(h)).cast("long").alias("rank")) for i, h in enumerate(at) for side in (0, 1)])
    wanted = first.withColumn("w_", F.explode(ranks)).where("w_.rank >= from_ AND w_.rank < from_ + n_")
    wanted = wanted.select(*by, "b1_", "low_", "high_", "all_", F.col("w_.name").alias("name_"), (F.col("w_.rank") - F.col("from_")).alias("rank_"))

    fine = F.coalesce(F.floor((x - F.col("low_")) / F.nullif(F.col("high_") - F.col("low_"), F.lit(0.0)) * FINE), F.lit(0)).cast("long")
    inside = grouped.join(F.broadcast(wanted.select(*by, "b1_", "low_", "high_").distinct()), [*by, "b1_"]).select(*by, "b1_", fine.alias("b2_"), "x_")
    second = placed(inside.groupBy(*by, "b1_", "b2_").agg(F.count("*").alias("n_")), [*by, "b1_"], "b2_", "n_")
    narrow = second.join(F.broadcast(wanted), [*by, "b1_"]).where("rank_ >= from_ AND rank_ < from_ + n_").select(*by, "b1_", "b2_", "all_", "name_", (F.col("rank_") - F.col("from_")).alias("rank_"))
    left = inside.join(F.broadcast(narrow.select(*by, "b1_", "b2_").distinct()), [*by, "b1_", "b2_"]).groupBy(*by, "b1_", "b2_", "x_").agg(F.count("*").alias("n_"))
    left = placed(left, [*by, "b1_", "b2_"], "x_", "n_")
    picked = left.join(F.broadcast(narrow), [*by, "b1_", "b2_"]).where("rank_ >= from_ AND rank_ < from_ + n_")
    ends = picked.groupBy(*by).agg(F.max("all_").alias("all_"), *[F.max(F.when(F.col("name_") == k, x)).alias(f"e{k}_") for k in range(2 * len(shares))])
    between = [F.col(f"e{2 * i}_") + (F.col(f"e{2 * i + 1}_") - F.col(f"e{2 * i}_")) * (h - F.floor(h)) for i, h in enumerate(at)]
    return ends.select(*by, F.array(*between).alias("q_"))


def _over(parts: list[str]) -> WindowSpec:
    return W.partitionBy(*parts) if parts else W.partitionBy(F.lit(0))


def by_position(facts: DataFrame, buckets: Buckets, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bucket, range, tokens, mean_kld, p95_kld, top1_agreement); empty buckets have 0 tokens and nulls."""
    good, placed = finite("kld"), facts.withColumn("bucket", buckets.column())
    stats = placed.groupBy(*by, "bucket").agg(F.count_if(good).alias("tokens"), F.avg(F.when(good, clipped("kld"))).alias("mean_kld"), F.avg(F.when(good, F.col("top1").cast("int"))).alias("top1_agreement"))
    scored = placed.where(good & F.col("bucket").isNotNull()).withColumn("kld", clipped("kld"))
    p95 = quantiles(scored, "kld", (0.95,), (*by, "bucket")).select(*by, "bucket", F.get("q_", F.lit(0)).alias("p95_kld"))
    frame = facts.sparkSession.createDataFrame([(i, label) for i, _, _, label in buckets.rows()], "bucket int, range string")
    frame = stats.select(*by).distinct().crossJoin(F.broadcast(frame)) if by else frame  # four rows
    return frame.join(stats, [*by, "bucket"], "left").join(p95, [*by, "bucket"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))


def histogram_bin(c: str | Column) -> Column:
    """Index of the half-open bin [a, b) of a value, by halving the edges; the last bin has no end."""
    c = F.col(c) if isinstance(c, str) else c

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(c >= EDGES[middle], among(middle, high)).otherwise(among(low, middle - 1))

    return among(0, len(EDGES) - 2)


def histogram(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, n) of finite, clipped divergences, with empty bins; one scan, counted before anything is shuffled."""
    counted = facts.groupBy(*by, F.when(finite("kld"), histogram_bin(clipped("kld"))).alias("bin")).agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))  # at most one for each bin
    bins = counted.groupBy(*by).agg(entries.alias("bins_")).select(*by, "bins_", F.explode(F.sequence(F.lit(0), F.lit(len(EDGES) - 2))).alias("bin"))
    return bins.select(*by, "bin", F.coalesce(F.try_element_at("bins_", "bin"), F.lit(0).cast("long")).alias("n"))


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def scalars(facts: DataFrame, by: tuple[str, ...] = (), shares: dict[str, float] = SHARES) -> DataFrame:
    """One row of statistics per student; without groups an empty table still gives its row of nulls. All but the quantiles (`shares` names them) come from one aggregation.

    Divergence, probability shift and floor are three populations, each filtered by its own finiteness. The floor is
    null for a student if any position never had one.
    """
    good, shift, floor = finite("kld"), finite("delta_p"), finite("floor_kld")
    kld = F.when(good, clipped("kld"))
    dp = F.when(shift, F.col("delta_p"))
    out = facts.groupBy(*by).agg(
        F.count_if(good).alias("tokens_scored"),
        F.count_if(~good).alias("tokens_dropped_nonfinite"),
        F.avg(kld).alias("mean"),
        F.max(kld).alias("max"),
        F.when(F.count(kld) > 1, F.stddev_samp(kld) / F.sqrt(F.count(kld))).alias("iid_se"),
        F.avg(F.when(good, F.col("top1").cast("int"))).alias("top1"),
        F.avg(F.when(good, F.col("top5").cast("int"))).alias("top5"),
        F.avg(dp).alias("delta_p_mean"),
        F.sqrt(F.avg(dp * dp)).alias("delta_p_rms"),
        F.when(F.count_if(F.col("floor_kld").isNull()) == 0, F.avg(F.when(floor, clipped("floor_kld")))).alias("floor_mean"),
        F.count_if(F.col("seq_id").isNull()).alias("unclustered_"),
    )
    if not shares:
        return out
    found = quantiles(facts.where(good).withColumn("kld", clipped("kld")), "kld", tuple(shares.values()), by)
    out = out.join(F.broadcast(found), list(by), "left") if by else out.join(F.broadcast(found), F.lit(True), "left")  # a row for each student
    return out.select("*", *[F.get("q_", F.lit(i)).alias(name) for i, name in enumerate(shares)]).drop("q_")


def summarize(facts: DataFrame, by: tuple[str, ...] = ("student",)) -> DataFrame:
    """Scalars with standard errors: clustered by sequence, or independent where any position lacks a sequence."""
    base = scalars(facts, by)
    kld = clustered_se(facts.where(finite("kld")).withColumn("kld", clipped("kld")), "kld", "seq_id", by).select(*by, F.col("se").alias("cse_"))
    dp = clustered_se(facts.where(finite("delta_p")), "delta_p", "seq_id", by).select(*by, F.col("se").alias("delta_p_se"))
    on = list(by)
    joined = base.join(kld, on, "left").join(dp, on, "left") if by else base.join(kld, F.lit(True), "left").join(dp, F.lit(True), "left")
    alone = F.col("unclustered_") > 0
    return joined.withColumn("se", F.when(alone, F.col("iid_se")).otherwise(F.col("cse_"))).withColumn("se_method", F.when(alone, "iid").otherwise("clustered-by-sequence")).drop("cse_", "iid_se", "unclustered_")


def floor_limited(mean: str = "mean", floor: str = "floor_mean") -> Column:
    """The mean is less than twice a positive floor: what is measured is mostly the reconstruction."""
    return F.coalesce((F.col(floor) > 0) & (F.col(mean) < 2.0 * F.col(floor)), F.lit(False))


def implausible(top1: str = "top1", mean: str = "mean", tokens: str = "tokens_scored") -> Column:
    """Why a result looks like a broken load rather than a quantisation, or null; either sign alone suffices."""
    none = F.when(F.col(tokens) == 0, F.lit("nothing could be scored"))
    low = F.when(F.col(top1) < 0.5, F.concat(F.lit("top-1 agreement "), F.format_string("%.2f%%", F.col(top1) * 100), F.lit(" is below 50%")))
    high = F.when(F.col(mean) > 1.0, F.concat(F.lit("mean divergence "), F.format_string("%.3f", F.col(mean)), F.lit(" is above 1.0")))
    return F.nullif(F.concat_ws("; ", none, low, high), F.lit(""))
