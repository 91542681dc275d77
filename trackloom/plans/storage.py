"""Tables in the shared folder, which end a plan's lineage: rounds of an iteration, and what several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a session on one machine gets a temporary one; a cluster must name one that all its
    machines share, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting that deletes an execution's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: what is read then survives lost executors without being computed anew."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP, None)
    df.sparkSession.conf.set(CLEANUP, "true")  # for this write alone, whose plan nothing runs again
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before or "false")
    return df.sparkSession.read.schema(df.schema).parquet(path)
