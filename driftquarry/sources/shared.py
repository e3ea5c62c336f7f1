"""The folder that all executors share: where lineage is cut and intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local mode makes its own; on a cluster, local-cluster included, its absence is an error, as a machine-local folder would not survive the loss of an executor."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Computed once, kept in the shared folder: for what several passes read and is dear to make."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
