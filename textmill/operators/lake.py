"""Writers of the corpus: partitioned Parquet, metadata-only files, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import hashing as H
from textmill.operators.tables import require_empty

SAFE_NAME = r"\A[A-Za-z0-9._-]+\z"


def flat(docs: DataFrame) -> DataFrame:
    """Corpus rows with the quality struct as columns, flags joined by commas."""
    return docs.withColumns({"edu_score": F.col("quality.edu_score"), "pii_flags": F.array_join("quality.pii_flags", ",")}).drop("quality")


def require_safe_sources(docs: DataFrame) -> None:
    require_empty(docs.where(~F.coalesce(F.col("source").rlike(SAFE_NAME), F.lit(False))).select("source").distinct(), "unsafe source names")


def write_rows(rows: DataFrame, root: str, *, mode: str) -> None:
    rows.write.mode(mode).partitionBy("source", "split").option("compression", "zstd").parquet(root)


def write_lake(docs: DataFrame, root: str, *, mode: str = "append") -> None:
    """Parquet by source and split; refuses sources that cannot be folder names."""
    require_safe_sources(docs)
    write_rows(flat(docs) if "quality" in docs.columns else docs, root, mode=mode)


def write_shards(docs: DataFrame, root: str, shards: int) -> None:
    """Rows in shards by content hash, ordered by doc_id within each."""
    placed = docs.withColumn("shard", H.shard_of("content_sha256", shards))
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(root)


def redistributable_view(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.when(F.col("redistributable"), F.col("text")))


def write_metadata_only(docs: DataFrame, path: str) -> None:
    """Rows that may not be passed on, without their texts."""
    docs.where(~F.col("redistributable")).drop("text").write.mode("overwrite").json(path)


def identity(docs: DataFrame) -> Column:
    return F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("content_sha256"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row: n and an order-free fingerprint of identities, summed over hashes so that nothing is gathered."""
    digest = H.sha256(identity(docs))
    parts = [F.sum(H.leading_number(F.substring(digest, 1 + 12 * k, 12), 12).cast("decimal(38,0)")) for k in range(4)]
    total = F.concat_ws("/", F.count(F.lit(1)).cast("string"), *[F.coalesce(p, F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts])
    return docs.agg(F.count(F.lit(1)).alias("n"), F.substring(F.sha2(total, 256), 1, 16).alias("fingerprint"))


def manifest(docs: DataFrame) -> DataFrame:
    """source with n, rows by split and the fingerprint of its ids."""
    split = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}")
    digest = H.leading_number(H.sha256("doc_id"), 12).cast("decimal(38,0)")
    ids = F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), F.sum(digest).cast("string")), 256)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), split("train"), split("val"), split("test"), ids.alias("ids_sha256"))


def write_manifest(docs: DataFrame, version: str) -> str:
    """The manifest of a corpus as JSON; one entry for each source."""
    entries = {r["source"]: {k: r[k] for k in ("n", "n_train", "n_val", "n_test", "ids_sha256")} for r in manifest(docs).collect()}
    return json.dumps({"dataset_version": version, "sources": entries}, sort_keys=True, indent=2)


def reconciled(kept: int, written: int, duplicates: int, overlaps: int) -> dict[str, int]:
    """The report's counts; raises unless kept documents are written, duplicates or overlaps."""
    if kept != written + duplicates + overlaps:
        raise ValueError(f"{kept} kept, but {written} written, {duplicates} duplicates and {overlaps} overlaps")
    return {"kept": kept, "written": written, "duplicates": duplicates, "overlaps": overlaps}


def segment_stats(stats: DataFrame) -> DataFrame:
    """One row over rows of segments: seen, kept, failed segments, tasks, longest and summed seconds."""
    return stats.agg(
        F.sum("seen").alias("seen"), F.sum("kept").alias("kept"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"),
        F.countDistinct("pid").alias("tasks"), F.max("seconds").alias("longest"), F.sum("seconds").alias("seconds"),
        (F.max("seconds") / F.avg("seconds")).alias("skew"),
    )
