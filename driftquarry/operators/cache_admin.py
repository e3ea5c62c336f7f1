"""Cache entries as a table: ages, budgets, what to evict, what is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entry_bytes(samples: Column, length: Column, k: Column) -> Column:
    """Estimated size of an entry: two bytes a log-probability, four an id, nine a position."""
    return samples * length * (6 * k + 9)


def used_at(last_used: str, created_at: str, modified: str) -> Column:
    """When an entry was last used: as recorded, else when created, else its file's time. Times without a zone are UTC (the session's zone)."""
    return F.coalesce(F.try_to_timestamp(F.col(last_used)), F.try_to_timestamp(F.col(created_at)), F.col(modified).cast("timestamp"))


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def plan_eviction(entries: DataFrame, budget: int, protect: tuple[str, ...] = ()) -> DataFrame:
    """Adds `evict`: the least recently used entries go until the rest fits the budget. Protected and locked entries stay and count.

    An entry goes if what is left after all older evictions is still too much. The running sum is over one cache's
    directory listing, never over its data.
    """
    free = ~F.col("locked") & ~F.col("key").isin(*protect) if protect else ~F.col("locked")
    marked = entries.withColumn("free_", free)
    order = W.partitionBy("free_").orderBy("last_used", "key").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("size_bytes").over(W.partitionBy())
    before = F.coalesce(F.sum("size_bytes").over(order), F.lit(0))
    return marked.withColumn("evict", F.col("free_") & (total - before > budget)).drop("free_")


def collect_garbage(entries: DataFrame, budget: int | None, oldest: Column | None) -> DataFrame:
    """Adds `reason`: `age` for entries last used before `oldest`, then `budget` for those that the rest's budget evicts, else null."""
    aged = entries.withColumn("aged_", ~F.col("locked") & (F.col("last_used") < oldest) if oldest is not None else F.lit(False))
    rest = aged.where("NOT aged_").drop("aged_")
    kept = plan_eviction(rest, budget) if budget is not None else rest.withColumn("evict", F.lit(False))
    kept = kept.withColumn("reason", F.when(F.col("evict"), "budget")).drop("evict")
    return aged.where("aged_").drop("aged_").withColumn("reason", F.lit("age")).unionByName(kept)


def validity(manifests: DataFrame, parts: DataFrame, version: int = 1) -> DataFrame:
    """(key, problem): the first thing wrong with an entry, or null. `parts`: (key, part), the shards that exist."""
    expected = manifests.where("num_batches > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("num_batches") - 1)).alias("part"))
    missing = expected.join(parts, ["key", "part"], "left_anti").groupBy("key").agg(F.min("part").alias("missing"))
    problem = (
        F.when(F.col("format_version").isNull(), "no manifest")
        .when(F.col("format_version") != version, F.concat(F.lit("format version "), F.col("format_version").cast("string")))
        .when(F.coalesce(F.col("num_batches"), F.lit(0)) <= 0, "no batches")
        .when(F.col("missing").isNotNull(), F.concat(F.lit("shard "), F.col("missing").cast("string"), F.lit(" is missing")))
    )
    return manifests.join(missing, "key", "left").select("key", problem.alias("problem"))
