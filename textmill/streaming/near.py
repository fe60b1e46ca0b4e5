"""Near-duplicates in a stream, against all that was kept within a horizon.

Every micro-batch is judged in the order of time and key: first against the kept documents
of earlier batches, by a narrow index of their bands, then within itself by the greedy
rounds of the batch operator.  A batch has folders of its own and is committed by a marker
that is written last, so a batch that is sent again changes nothing, and one that broke off
is judged anew from the same state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators import dedup
from textmill.operators.dedup import LshParams
from textmill.operators.sampling import numbered
from textmill.operators.tables import checkpointed


@dataclass
class NearDuplicateStream:
    """State under a shared folder; horizon is how many seconds a kept document is remembered.

    Time runs by the latest row of the committed batches: documents older than that by
    more than the horizon are forgotten before a batch is judged.  Rows that come late are
    judged like others, against what is remembered.  Null times are as old as can be; null
    keys can't be told apart and are left out; null texts count as empty.
    """

    spark: SparkSession
    path: str
    horizon: float
    params: LshParams = field(default_factory=LshParams)
    key: str = "doc_id"
    at: str = "acquired_at"

    def _folders(self, what: str) -> dict[int, str]:
        """Complete folders of a kind by batch, in one listing."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{what}/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return {int(f.getPath().getParent().getName()): f.getPath().getParent().toString() for f in found or ()}

    def committed(self) -> list[int]:
        return sorted(self._folders("commit"))

    def _to(self, what: str, batch: int) -> str:
        return f"{self.path.rstrip('/')}/{what}/{batch}"

    def _remembered(self, what: str, marks: list[tuple], since: float | None) -> DataFrame | None:
        """Rows of the kept documents of committed batches that are not forgotten; batches that are wholly so are not opened."""
        paths = [self._to(what, b) for b, latest in marks if since is None or (latest is not None and latest >= since)]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        return rows if since is None else rows.where(F.col("at") >= since)

    def judge(self, rows: DataFrame, batch: int) -> bool:
        """Judge rows (key, at, text) as batch number `batch`; False if it had been committed before."""
        if batch in self._folders("commit"):
            return False
        commits = list(self._folders("commit").values())
        marks = [(r["batch"], r["latest"]) for r in self.spark.read.parquet(*commits).collect()] if commits else []
        now = max((latest for _, latest in marks if latest is not None), default=None)
        since = None if now is None else now - self.horizon
        named = rows.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("id"), F.col(self.at).cast("timestamp").cast("double").alias("at"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["id"])
        signed = dedup.signatures(named, self.params, key="id").join(named.select("id", "at"), "id").withColumn("all", F.lit(0))
        signed = checkpointed(numbered(signed, "all", F.coalesce("at", F.lit(float("-inf"))), "place", ties=("id",)).drop("all"), "stream-signed")
        heads = dedup.classes(signed, "place")
        seen = self._beside_kept(heads, marks, since)
        fresh = heads.join(seen.select("place"), "place", "left_anti") if seen is not None else heads
        edges = checkpointed(dedup.similar_pairs(fresh, fresh, self.params, "place", ordered=True).select("a", "b", "jaccard"), "stream-pairs")
        state = dedup.settled(edges)
        ids = signed.select("place", "id")
        best = edges.join(state.where("kept").select(F.col("node").alias("a")), "a").groupBy("b").agg(F.min_by("a", F.struct(-F.col("jaccard"), "a")).alias("a"))
        dropped = best.join(state.where("not kept").select(F.col("node").alias("b")), "b").join(ids.select(F.col("place").alias("a"), F.col("id").alias("of")), "a").select(F.col("b").alias("head"), "of")
        if seen is not None:
            dropped = dropped.unionByName(seen.select(F.col("place").alias("head"), "of"))
        led = signed.join(heads.select("signature", F.col("place").alias("head")), "signature").join(dropped, "head", "left")
        first = ids.select(F.col("place").alias("head"), F.col("id").alias("first"))
        told = led.join(first, "head").select("id", "at", "signature", F.coalesce("of", F.when(F.col("place") != F.col("head"), F.col("first"))).alias("duplicate_of"))
        told = checkpointed(told, "stream-told")
        told.select("id", "at", "duplicate_of").write.mode("overwrite").parquet(self._to("decisions", batch))
        kept = told.where("duplicate_of is null").select("id", "at", "signature")
        kept.write.mode("overwrite").parquet(self._to("kept", batch))
        dedup.bands(kept, self.params).select("band", "value", "id", "at").write.mode("overwrite").parquet(self._to("bands", batch))
        told.agg(F.max("at").alias("latest")).select(F.lit(batch).alias("batch"), "latest").coalesce(1).write.mode("overwrite").parquet(self._to("commit", batch))
        return True

    def _beside_kept(self, heads: DataFrame, marks: list[tuple], since: float | None) -> DataFrame | None:
        """place and of: the most similar remembered document of each class that resembles one, the smallest key of several."""
        index, kept = self._remembered("bands", marks, since), self._remembered("kept", marks, since)
        if index is None or kept is None:
            return None
        mine = dedup.bands(heads, self.params).select("place", "band", "value")
        # keys alone meet in the bands; signatures are fetched for pairs
        pairs = mine.join(index.select("band", "value", F.col("id").alias("of")), ["band", "value"]).select("place", "of").distinct()
        both = pairs.join(heads.withColumnRenamed("signature", "sa"), "place").join(kept.select(F.col("id").alias("of"), F.col("signature").alias("sb")), "of")
        near = both.select("place", "of", dedup.estimated_jaccard("sa", "sb").alias("jaccard")).where(F.col("jaccard") >= self.params.threshold)
        return checkpointed(near.groupBy("place").agg(F.min_by("of", F.struct(-F.col("jaccard"), "of")).alias("of")), "stream-beside")

    def decisions(self) -> DataFrame:
        """id, at and duplicate_of (null: kept) of all rows of the committed batches."""
        done = self._folders("commit")
        paths = [p for b, p in self._folders("decisions").items() if b in done]
        if not paths:
            return self.spark.createDataFrame([], "id long, at double, duplicate_of long")
        return self.spark.read.parquet(*paths)

    def vacuum(self) -> list[int]:
        """Delete bands and signatures of batches that are wholly forgotten; their decisions stay.  Returns their numbers."""
        commits = self._folders("commit")
        marks = [(r["batch"], r["latest"]) for r in self.spark.read.parquet(*commits.values()).collect()] if commits else []
        now = max((latest for _, latest in marks if latest is not None), default=None)
        old = sorted(b for b, latest in marks if now is not None and (latest is None or latest < now - self.horizon))
        jvm = self.spark._jvm
        for b in old:
            for what in ("bands", "kept"):
                at = jvm.org.apache.hadoop.fs.Path(self._to(what, b))
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return old

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Judge every micro-batch of a stream; the query that runs."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.judge(rows, batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
