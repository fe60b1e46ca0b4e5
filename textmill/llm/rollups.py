"""Token counts in rollups that are maintained by deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed rows of a log, and
their sums by source, language and tokenizer version are added to the totals before it.
Every batch has folders of its own and is committed by a marker that is written last, so a
batch that is sent again changes nothing, and one that broke off is written anew.  Every
COMPACT batches what the log holds is written as a snapshot, from which later batches
start; vacuum() deletes the log that a snapshot has replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.packing import tokenizer
from textmill.llm.runtime import map_batches, staged

KEYS = ("source", "lang", "tokenizer")
CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
_LOG = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, slot int"
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
COMPACT = 8
#: Folders that logs and snapshots are cut into, by hash of doc_id: a batch reads those of its documents.
SLOTS = 64


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")


def _write(rows: DataFrame, path: str) -> None:
    """rows in a folder for each slot, in few files: all of a slot come from one task unless Spark splits it."""
    rows.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(path)


class Rollup:
    """Totals under a shared folder; batches are numbered 1, 2, ... and committed in order."""

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact

    def _written(self, what: str) -> list[int]:
        """Numbers of the folders of a kind that are complete, by one listing."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName()) for f in found or ())

    def committed(self) -> int:
        """The number of the last committed batch, 0 before the first."""
        return max(self._written("commit"), default=0)

    def held(self, upto: int, keys: DataFrame | None = None, slots: list[int] | None = None) -> DataFrame:
        """What documents count after batch `upto`: the last snapshot and the log since then.

        With keys (doc_id, tokenizer) and their slots only these folders are read, and rows
        of other keys are left out before anything is grouped: a small batch is sent to
        what is held, not the other way round.
        """
        base = max((k for k in self._written("snapshot") if k <= upto), default=0)
        paths = [f"{self.path}/snapshot/{base}"] if base else []
        paths += [f"{self.path}/log/{k}" for k in range(base + 1, upto + 1)]
        if not paths:
            return self.spark.createDataFrame([], _LOG)
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(_LOG).parquet(p) for p in paths])
        if slots is not None:
            rows = rows.where(F.col("slot").isin(slots) if slots else F.lit(False))
        if keys is not None:
            rows = rows.join(keys.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        if len(paths) == 1:
            return rows.where("docs > 0")
        return rows.groupBy("slot", "doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")

    def totals(self, at: int | None = None) -> DataFrame:
        """Totals after batch `at`, by default the last; groups without documents are left out."""
        at = self.committed() if at is None else at
        if at == 0:
            return self.spark.createDataFrame([], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self.path}/totals/{at}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes as batch number `batch`; False if it had been committed before.

        changes holds CHANGES; doc_id and tokenizer are its key.  insert adds a document,
        or puts it in place of the one held; revise replaces the count, delete takes the
        document out; both do nothing for documents that are neither held nor inserted.
        Changes of one key in a batch take effect in this order.  Of several inserts or
        revisions of a key the largest (source, language, count) counts, so repeated rows
        count once.  A null count is 0; null source or language is a group of its own; a
        null op, doc_id or tokenizer is left out.  An empty batch is committed and changes
        nothing.  A batch reads the folders of its documents, and moves the rows held of them.
        """
        done = self.committed()
        if batch <= done:
            return False
        if batch != done + 1:
            raise ValueError(f"batch {batch} comes after {done}")
        n = F.coalesce("n_tokens", F.lit(0)).cast("long")
        net = changes.where("op is not null and doc_id is not null and tokenizer is not null").groupBy("doc_id", "tokenizer").agg(
            F.max(F.when(F.col("op") == "insert", F.struct("source", "lang", n.alias("tokens")))).alias("new"),
            F.max(F.when(F.col("op") == "revise", n)).alias("revised"),
            F.max(F.col("op") == "delete").alias("gone"),
        )
        # changes are worked out once and written: their slots tell what is read
        at = f"{self.path}/net/{batch}"
        net.withColumn("slot", _slot()).write.mode("overwrite").parquet(at)
        net = self.spark.read.schema(net.withColumn("slot", _slot()).schema).parquet(at)
        slots = [r[0] for r in net.select("slot").distinct().collect()]
        net = net.drop("slot")
        before = self.held(done, net, slots).select("doc_id", "tokenizer", F.struct("source", "lang", "tokens").alias("old"))
        both = net.join(before, ["doc_id", "tokenizer"], "left")
        after = F.coalesce("new", "old")
        told = F.when(after.isNotNull() & ~F.col("gone"), F.struct(after["source"].alias("source"), after["lang"].alias("lang"), F.coalesce("revised", after["tokens"]).alias("tokens"), F.lit(1).alias("sign")))
        taken = F.when(F.col("old").isNotNull(), F.struct("old.source", "old.lang", "old.tokens", F.lit(-1).alias("sign")))
        signed = both.select("doc_id", "tokenizer", F.explode(F.array_compact(F.array(taken, told))).alias("x")).select(
            "doc_id", "x.source", "x.lang", "tokenizer", F.col("x.sign").cast("long").alias("docs"), (F.col("x.sign") * F.col("x.tokens")).cast("long").alias("tokens"), _slot()
        )
        _write(signed, f"{self.path}/log/{batch}")
        delta = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/{batch}").groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        total = self.totals(done).unionByName(delta).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")
        total.write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        if batch % self.compact == 0:
            _write(self.held(batch), f"{self.path}/snapshot/{batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commit/{batch}")
        return True

    def vacuum(self) -> None:
        """Delete the log, snapshots and totals that the last snapshot of a committed batch has replaced."""
        last = max((k for k in self._written("snapshot") if k <= self.committed()), default=0)
        jvm = self.spark._jvm
        for what, below in (("log", last + 1), ("net", last + 1), ("snapshot", last), ("totals", last)):
            for k in self._written(what):
                if k < below:
                    at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/{k}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Simple tokenizers: patterns whose matches are counted.
WORDS, LETTERS = r"[^\x20\x09-\x0D]+", r"\p{L}+"


def pattern_counts(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, source, lang and a count for each pattern; null texts have none."""
    return docs.select("doc_id", "source", "lang", *[F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias(name) for name, p in patterns.items()])


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, source, lang, bpe (ids of the tokenizer) and words (between white space) of every row; null texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("bpe", pa.int64()), ("words", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            words = pc.count_substring_regex(text, WORDS).cast(pa.int64())
            kept = [batch.column(c).cast(schema.field(c).type) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(encoder.count(text.to_pylist()), pa.int64()), words], schema=schema)

    return docs.select("doc_id", "source", "lang", "text").transform(map_batches, rows, "doc_id long, source string, lang string, bpe long, words long")


def _lived(counts: DataFrame, labels: DataFrame, path: str, versions: list[str], revised: str, to) -> DataFrame:
    """Totals after a corpus's life in batches: all documents come in under every version; those labelled toxic go; of those labelled poor, version `revised` is counted anew; a batch is sent twice."""
    rollup = Rollup(counts.sparkSession, path)
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct()

    def change(rows: DataFrame, op: str, each: dict) -> DataFrame:
        made = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), n.cast("long").alias("n_tokens")) for v, n in each.items()]))
        return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", made.alias("x")).select("op", "doc_id", "source", "lang", "x.*")

    rollup.commit(1, change(counts, "insert", {v: F.col(v) for v in versions}))
    none = {c: F.lit(None).cast("string") for c in ("source", "lang")}
    deletes = change(toxic.withColumns(none), "delete", {v: F.lit(None) for v in versions})
    rollup.commit(2, deletes)
    rollup.commit(2, deletes)
    rollup.commit(3, change(counts.join(poor, "doc_id", "left_semi"), "revise", {revised: to}))
    return rollup.totals()


def document_totals(docs: DataFrame, labels: DataFrame, path: str, tokenizer_path: str) -> DataFrame:
    """Totals of documents by source, language and tokenizer version, after inserts, deletes and revisions.

    Versions: ids of the tokenizer, and words between white space.  Texts are read and
    counted once.  Documents labelled toxic are deleted; those labelled poor are revised to
    a count with a closing id.  Null and empty texts count 0; rows without a doc_id are left
    out, and rows that repeat one count once (the one with the largest source, language and
    count); labels repeated or null do no harm; no documents give no rows.
    """
    counts = staged(token_counts(docs, tokenizer_path), "rollup-counts")
    return _lived(counts, labels, path, ["bpe", "words"], "bpe", F.col("bpe") + 1)


def word_totals(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """The same under two simple versions that SQL knows too: words and runs of letters; poor documents' words are recounted as runs of letters."""
    counts = staged(pattern_counts(docs, {"words": WORDS, "letters": LETTERS}), "rollup-counts")
    return _lived(counts, labels, path, ["words", "letters"], "words", F.col("letters"))
