"""Cutting lineage and keeping tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: bytes of an Arrow batch; rows hold whole texts or their words and say little of a batch's size
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with the Arrow batches that its tasks exchange with Python bounded in bytes, and shuffle files removed when their query has ended."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which driver and executors share; a folder of our own is set only where none is, on a single machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at or "/tmp/checkpoints/dagspark")
    return (at or sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, for loops: a checkpoint would hand on the constraints that were inferred of its rows, which grow from round to round on the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
