"""Statistics that grow with a stream of scored positions, exact at any time.

Each micro-batch is appended to a fact table under its number, so a batch that runs again after a failure
replaces itself. Statistics are computed from the table when asked for: means, errors and histograms could be
merged from partial sums, exact quantiles could not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftquarry.sources import shared


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return shared.scratch(spark, "stream")


def accumulate(stream: DataFrame, facts: str, checkpoint: str, alarm: Callable[[int, float], None] | None = None, threshold: float = 1e-4) -> None:
    """Append all that is available in `stream` to the table `facts`; `alarm` is told the first batch whose padded mass isn't below the threshold."""
    told: list[int] = []

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{facts}/batch={number}")
        if alarm and not told and "pad_mass" in batch.columns:
            worst = batch.agg(F.max("pad_mass")).first()[0]
            if worst is not None and not worst <= threshold:
                told.append(number)
                alarm(number, worst)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accumulated(spark: SparkSession, facts: str) -> DataFrame:
    return spark.read.parquet(facts).drop("batch")


def staged(rows: DataFrame, path: str, batches: int = 4) -> int:
    """Write rows as files of a folder for `available`, and how many files make one of `batches` batches.

    Each task of the input writes its own rows, so what a task handles doesn't grow with the table; nothing is shuffled,
    unless there are fewer tasks than batches, and then the table is small.
    """
    parts = rows.rdd.getNumPartitions()
    (rows if parts >= batches else rows.repartition(batches)).write.parquet(path)
    return -(-max(parts, batches) // batches)


def available(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a folder's files, some at a time; rows and results are those of a batch scan."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
