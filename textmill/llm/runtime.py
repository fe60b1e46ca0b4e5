"""Shared folders, staged tables and bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.tables import scratch_folder, shared_folder

#: Bytes of an Arrow batch between the JVM and its Python workers, so that long texts do not fill either.
BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all runs on this machine, as in tests."""
    return shared_folder(spark)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as a shuffle has: a small table whose rows are about to multiply may lie in very few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, function, ddl: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, ddl)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hashed_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """df with h, cut to the share of hashes that holds about twice `rows` rows: what is then ordered and limited is small in every task."""
    n = df.count()
    marked = df.withColumn("h", F.xxhash64(key, F.lit(seed)))
    if n <= 2 * rows:
        return marked
    return marked.where(F.pmod("h", F.lit(1 << 30)) < int(2 * rows / n * (1 << 30)))
