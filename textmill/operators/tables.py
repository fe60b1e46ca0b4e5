"""Shared folders for tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where none is set and everything runs on it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textmill-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application's written tables go to."""
    return f"{shared_folder(spark)}/textmill-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application wrote to cut lineage; frames that read them can't be used any more, so results are written first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read back: lost executors cost no work before it.  sweep() deletes what is left of it."""
    path = f"{scratch_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows: 10,000 whole texts at once may fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it has fewer files than these: such a table may be one row group, which a single task would read however it is split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def require_empty(rows: DataFrame, message: str) -> None:
    """Raise ValueError with a few of the rows, if there are any."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")
