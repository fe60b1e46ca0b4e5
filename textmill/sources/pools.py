"""Pools of documents to scan and rows to train on, read from lakes of Parquet files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import audits, sampling
from textmill.operators.tables import require_empty

# Layout of a human lake; columns that a pool needs, and those that only generated texts have.
HUMAN_PATTERN = "source=*/split=*/*.parquet"
NEEDED = ("doc_id", "source_group_id", "text")
GENERATED = ("generator", "label", "sample_id")
# What stands for a missing field of a reserve document.
UNKNOWN = {"source": "unknown", "domain": "unknown", "register": "informational"}
SPLITS = ("train", "val", "test")
_SPAN = "array<struct<start_char:bigint,end_char:bigint,label:string>>"


def footers(spark: SparkSession, root: str, pattern: str = HUMAN_PATTERN) -> DataFrame:
    """path, n_rows, columns and error of each file that matches, from its footer alone; tasks read them in parallel."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()
    paths = sorted(f.getPath().toString() for f in found)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import ArrowException
        from pyarrow.fs import FileSystem

        for part in batches:
            rows = []
            for path in part["path"]:
                try:
                    system, inner = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                    with system.open_input_file(inner) as f, pq.ParquetFile(f) as parquet:
                        rows.append((path, parquet.metadata.num_rows, parquet.schema_arrow.names, None))
                except (ArrowException, OSError) as e:
                    rows.append((path, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "n_rows", "columns", "error"]).astype({"n_rows": "Int64"})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInPandas(read, "path string, n_rows long, columns array<string>, error string")


def judged_footers(found: DataFrame) -> DataFrame:
    """footers() with finding (generated, incomplete, unreadable or null) and the columns that tell it."""
    of = lambda names: F.array(*[F.lit(n) for n in sorted(names)])
    marks, missing = F.array_intersect(of(GENERATED), "columns"), F.array_except(of(NEEDED), "columns")
    finding = F.when(F.col("error").isNotNull(), "unreadable").when(F.size(marks) > 0, "generated").when(F.size(missing) > 0, "incomplete")
    return found.withColumns({"finding": finding, "told_by": F.when(finding == "generated", marks).when(finding == "incomplete", missing)})


def plan_scan(spark: SparkSession, root: str, threshold: float, pattern: str = HUMAN_PATTERN) -> DataFrame:
    """path and n_rows of a pool that may be scanned; ValueError names every file that stands against it.

    Refused are an empty pool, files of generated texts, files without the columns needed,
    and files that cannot be opened.
    """
    if not 0.0 < threshold < 1.0:
        raise ValueError(f"the threshold {threshold} is no probability")
    found = judged_footers(footers(spark, root, pattern)).cache()
    try:
        # one row for each file that is at fault
        faults = found.where("finding is not null").orderBy("finding", "path").collect()
        if faults:
            raise ValueError("\n".join([f"{len(faults)} files cannot be scanned:", *(f"{r['finding']}: {r['path']} {r['told_by'] or r['error']}" for r in faults)]))
        if found.isEmpty():
            raise ValueError(f"no Parquet files under {root}")
    finally:
        found.unpersist()
    return found.select("path", "n_rows").orderBy("path")


def reserve(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents to mine, by doc_id: without blank and null texts, with stand-ins for missing fields."""
    missing = set(NEEDED) - set(docs.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    real = docs.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    field = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(UNKNOWN[c])) if c in docs.columns else F.lit(UNKNOWN[c])
    rows = real.select(*NEEDED, *[field(c).alias(c) for c in UNKNOWN]).orderBy("doc_id")
    return rows.limit(limit) if limit else rows


def _one_span(label: str):
    return F.array(F.struct(F.lit(0).cast("bigint").alias("start_char"), F.length("text").cast("bigint").alias("end_char"), F.lit(label).alias("label"))).cast(_SPAN)


def _rows(df: DataFrame, key: str, label, spans, family=None, released=None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    domain = F.coalesce("domain", F.lit("unknown")) if "domain" in df.columns else F.lit("unknown")
    return df.select(
        F.col(key).cast("string").alias("doc_id"), F.col("source_group_id").cast("string").alias("source_group_id"), "split", "text", label.cast("int").alias("label"), spans.alias("spans"),
        domain.alias("domain"), text(family).alias("generator_family"), text(released).alias("generator_released"),
    )


def training_rows(
    human: DataFrame | None = None, ai: DataFrame | None = None, mixed: DataFrame | None = None, *, splits: tuple[str, ...] = SPLITS, arm: str | None = None,
    human_cap: int | None = None, ai_cap: int | None = None, ai_reference: DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Rows to train on: human texts (label 0), generated ones (1), mixed ones (1 if half of the characters or more are not human).

    human holds doc_id, source_group_id, split, text and domain; ai holds sample_id for
    doc_id, and generator_family, generator_released and prompt_version; mixed holds spans.
    Rows of other splits (null too) are left out.  arm checks the prompts of all that ai
    holds in these splits.  Caps keep the shares of the splits; with ai_reference, also its
    lengths.  limit takes rows of all (side, split) in turn.  Null texts have an empty span.
    """
    within = lambda df: df.where(F.col("split").isin(*splits))
    sides = []
    if human is not None:
        rows = _rows(within(human), "doc_id", F.lit(0), _one_span("human"))
        sides.append(rows if human_cap is None else sampling.cap_documents(rows, human_cap))
    if ai is not None:
        chosen = within(ai)
        if arm is not None:
            audits.require_arm(chosen, arm)
        rows = _rows(chosen, "sample_id", F.lit(1), _one_span("ai_generated"), F.coalesce("generator_family", F.lit("unknown")), F.coalesce(F.col("generator_released").cast("string"), F.lit("")))
        if ai_cap is not None:
            rows = sampling.cap_documents(rows, ai_cap) if ai_reference is None else sampling.cap_documents_matching(rows, ai_reference, ai_cap)
        sides.append(rows)
    if mixed is not None:
        from textmill.functions.spans import ai_char_fraction

        spans = F.col("spans").cast(_SPAN)
        sides.append(_rows(within(mixed), "doc_id", (ai_char_fraction(F.col("text"), spans) >= 0.5), spans))
    if not sides:
        raise ValueError("no rows to train on: give human, ai or mixed")
    numbered = [s.withColumn("__side", F.concat_ws("/", F.lit(k).cast("string"), F.col("split"))) for k, s in enumerate(sides)]
    union = numbered[0]
    for s in numbered[1:]:
        union = union.unionByName(s)
    return (union if limit is None else sampling.interleave(union, "__side", "doc_id", limit).drop("turn")).drop("__side")


def require_no_held_out(roster: DataFrame, used: DataFrame) -> None:
    """Raise if a family that roster (family, role) holds out is used."""
    require_empty(roster.where("role = 'held_out'").join(used.select("family"), "family", "left_semi").select("family").distinct(), "held-out families in use")
