"""Versions of a corpus that readers see whole or not at all.

A version's rows go to a folder of their own; what was written is counted on the way and
must be what is read back; then a marker with the manifest makes the version visible.  A
write that breaks off, or that does not read back as it was, leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textmill.functions import hashing as H
from textmill.operators import lake


class BrokenWrite(RuntimeError):
    """What was read back is not what was written."""


def _sums(digest: Column) -> list[Column]:
    """Four sums over parts of a digest: the same in whatever order rows come, and added up by Spark."""
    return [F.coalesce(F.sum(H.leading_number(F.substring(digest, 1 + 12 * k, 12), 12).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]


def _told(values: dict) -> str:
    """16 hex digits over a count and sums."""
    import hashlib

    return hashlib.sha256("/".join(str(int(values[k])) for k in ("n", "s0", "s1", "s2", "s3")).encode()).hexdigest()[:16]


def _identity() -> Column:
    return H.sha256(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("content_sha256"), F.col("split")))


def segments_fingerprint(segments: DataFrame) -> str:
    """Of the segments' paths: a local path counts by its last part, so a copy elsewhere is the same."""
    path = F.when(F.col("path").startswith("/"), F.substring_index("path", "/", -1)).otherwise(F.col("path"))
    return _told(segments.agg(F.count(F.lit(1)).alias("n"), *_sums(H.sha256(path))).first().asDict())


@dataclass
class Corpus:
    """Versions 1, 2, ... under a folder; one writer at a time."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/versions/*/_SUCCESS")
        return sorted(int(f.getPath().getParent().getName()) for f in fs.globStatus(at) or ())

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the last; None before the first."""
        known = self.versions()
        if version is None and not known:
            return None
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}; there are {known}")
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version}").first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        told = self.manifest(version)
        if told is None:
            raise ValueError("nothing has been published")
        return self.spark.read.parquet(f"{self.root}/{told['folder']}")

    def publish(self, docs: DataFrame, *, segments: DataFrame | None = None, counts: dict | None = None) -> dict:
        """Write docs (doc_id, content_sha256, source, split and more) as the next version; its manifest.

        segments (path, failed) are those that the corpus was made from: with a failed one
        among them nothing is published (BrokenWrite).  counts are the report's, which must
        add up: kept = rows + duplicates + overlaps.  Sources must be names of folders.  Null ids, digests and splits count as
        left out of the identity; an empty corpus is a version without rows.
        """
        crawl = None
        if segments is not None:
            failed = segments.where("failed").count()
            if failed:
                raise BrokenWrite(f"{failed} segments failed; the corpus would not be what was planned")
            crawl = {"segments": segments.count(), "fingerprint": segments_fingerprint(segments)}
        lake.require_safe_sources(docs)
        version = (self.versions() or [0])[-1] + 1
        folder = f"data/{version}-{uuid.uuid4().hex}"
        seen = Observation(f"written-{uuid.uuid4().hex}")
        measured = [F.count(F.lit(1)).alias("n"), *_sums(_identity())]
        if docs.isEmpty():
            docs.write.parquet(f"{self.root}/{folder}")
            written = {"n": 0, **{f"s{k}": 0 for k in range(4)}}
        else:
            # counted while it is written: docs are made once
            lake.write_rows(docs.observe(seen, *measured), f"{self.root}/{folder}", mode="error")
            written = seen.get
        back = self.spark.read.schema(docs.schema).parquet(f"{self.root}/{folder}")
        found = back.agg(*measured).first().asDict()
        if _told(found) != _told(written):
            raise BrokenWrite(f"{found['n']} rows read back of {written['n']}, or others than were written")
        if counts is not None:
            lake.reconciled(counts["kept"], written["n"], counts["duplicates"], counts["overlaps"])
        by_split = {"null" if r[0] is None else r[0]: r[1] for r in back.groupBy("split").count().collect()}
        told = {
            "version": version, "folder": folder, "rows": written["n"], "fingerprint": _told(written), "by_split": by_split,
            "sources": {r["source"]: r["n"] for r in back.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}, "crawl": crawl, "counts": counts, "split_salt": H.SPLIT_SALT,
        }
        self.spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/versions/{version}")
        return told

    def sweep(self) -> list[str]:
        """Delete folders of rows that no version names: writes that broke off.  Not while one is under way."""
        named = {self.manifest(v)["folder"].rsplit("/", 1)[1] for v in self.versions()}
        fs, at = self._fs(f"{self.root}/data/*")
        gone = [f.getPath() for f in fs.globStatus(at) or () if f.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)
