"""Secret scans over histories of texts, in DataFrame functions only.

Texts are addressed by content: a blob is the SHA-256 of a text, and however many paths
and versions hold it, each version of a pack of rules scans it once.  The ledger keeps
which blobs a pack has scanned and what it found; a scan looks at blobs that are new and
at packs that have changed, and joins what is known back to all paths.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.runtime import staged


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern that do not overlap, of which group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


@dataclass(frozen=True)
class Pack:
    """Rules that are scanned together; their digest is their version."""

    name: str
    rules: tuple[Rule, ...]

    @property
    def version(self) -> str:
        return f"{self.name}@{hashlib.sha256(repr(self.rules).encode()).hexdigest()[:16]}"


def _either_case(pattern: str) -> str:
    """The pattern with each letter in either case, as classes: flags fold letters beyond ASCII too in some engines."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


BASE = Pack("base", (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
))
#: Formats that services publish for their keys.
FORMATS = Pack("formats", (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
))
PACKS = (BASE, FORMATS)

#: Bytes of a blob or of a finding, about; as many of them are broadcast as the session's threshold of broadcasts allows.
ROW_BYTES = 120

_SCANNED = "blob string, packs array<string>"
_FINDINGS = "blob string, pack string, kind string, start int, end int"


def _broadcast_rows(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) // ROW_BYTES


def _hinted(rows: DataFrame, n: int) -> DataFrame:
    """rows to join with: broadcast if they are few, else hashed within the partitions of a shuffle, so that texts are not sorted."""
    return F.broadcast(rows) if n <= _broadcast_rows(rows.sparkSession) else rows.hint("shuffle_hash")


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.length(x))


def _matches(text: Column, pack: Pack, rule: Rule) -> Column:
    """Lengths of a rule's matches, of their groups, and of what lies before each and after the last; null without a match."""
    found = [_lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g))) for g in (0, rule.group)]
    between = _lengths(F.split(text, rule.pattern, -1))
    told = F.struct(F.lit(pack.version).alias("pack"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), F.arrays_zip(between.alias("gap"), found[0].alias("own"), found[1].alias("value")).alias("m"))
    return F.when(F.array_contains("packs", pack.version) & text.rlike(rule.pattern), told)


def find(blobs: DataFrame, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
    """Findings in blobs (blob, text, packs: the versions that are due): blob, pack, kind, start and end in code points, end exclusive.

    Only blobs with a match leave the scan.  Repeated rows count once; null texts have none.
    """
    each = [_matches(F.col("text"), p, r) for p in packs for r in p.rules]
    hits = blobs.select("blob", F.explode(F.array_compact(F.array(*each))).alias("x")).select("blob", "x.*")
    hits = hits.dropDuplicates(["blob", "pack", "kind"]).select("blob", "pack", "kind", "least", F.posexplode("m").alias("nth", "m"))
    upto = Window.partitionBy("blob", "pack", "kind").orderBy("nth")
    end = F.sum(F.col("m.gap") + F.coalesce("m.own", F.lit(0))).over(upto)
    placed = hits.withColumn("end", end.cast("int")).where("m.own is not null and m.value >= least")
    return placed.select("blob", "pack", "kind", (F.col("end") - F.col("m.own")).alias("start"), "end")


class BlobLedger:
    """What has been scanned and found, in a shared folder.

    A scan's findings and paths are written first; the list of what it scanned is written
    last and commits it, so a scan that broke off leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/scanned/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(f.getPath().getParent().getParent().toString() for f in found or ())

    def _read(self, what: str, schema: str | None = None) -> DataFrame | None:
        paths = [f"{b}/{what}" for b in self._batches()]
        if not paths:
            return None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*paths)

    def due(self, paths: DataFrame, packs: tuple[Pack, ...] = PACKS) -> DataFrame:
        """Of paths (blob, handle), each blob that some pack has not scanned, with those packs and the least handle."""
        blobs = paths.groupBy("blob").agg(F.min("handle").alias("handle"))
        wanted = F.array(*[F.lit(p.version) for p in packs])
        known = self._read("scanned", _SCANNED)
        if known is None:
            return blobs.withColumn("packs", wanted)
        known = known.groupBy("blob").agg(F.flatten(F.collect_set("packs")).alias("seen"))
        left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(known, "blob", "left").select("blob", "handle", left.alias("packs")).where(F.size("packs") > 0)

    def scan(self, versions: DataFrame, keys: tuple[str, ...], packs: tuple[Pack, ...] = PACKS) -> DataFrame:
        """Scan versions (keys that name a path and a version, text) and return report() of them.

        Each text is read once for its address, and once more where it is due; of copies
        the one with the least handle (a hash of its keys) is scanned.  Null texts are
        empty; keys may be null or repeated, each row is a path of its own; an empty
        table is committed and gives no rows.  Keys must not be called blob or spans.
        """
        addressed = versions.select(*keys, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"), F.xxhash64(*keys).alias("handle"), "text")
        paths = staged(addressed.drop("text"), "secret-paths")
        due = staged(self.due(paths, packs), "secret-due")
        n, batch = due.count(), f"{self.path}/{uuid.uuid4().hex}"
        texts = addressed.select("blob", "handle", "text").join(_hinted(due, n), ["blob", "handle"])
        find(texts, packs).write.parquet(f"{batch}/findings")
        paths.drop("handle").write.parquet(f"{batch}/paths")
        due.select("blob", "packs").write.parquet(f"{batch}/scanned")
        return self.report(packs, paths.drop("handle"))

    def report(self, packs: tuple[Pack, ...] = PACKS, paths: DataFrame | None = None) -> DataFrame:
        """Paths (by default all that were ever scanned) with blob and spans: array of (start, rank, kind, end), by start and then as the rules are listed."""
        kinds = [r.kind for p in packs for r in p.rules]
        paths = self._read("paths") if paths is None else paths
        rank = reduce(lambda at, k: at.when(F.col("kind") == k[1], k[0]), enumerate(kinds), F).otherwise(len(kinds))
        found = self._read("findings", _FINDINGS).where(F.col("pack").isin([p.version for p in packs]))
        spans = found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
        most = _broadcast_rows(self.spark)
        few = found.limit(most + 1).count() <= most
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        return paths.join(F.broadcast(spans) if few else spans, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def _text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def document_secrets(docs: DataFrame, path: str) -> DataFrame:
    """Digest of the findings in documents, scanned into a new ledger at path: doc_id, counts of the base kinds, the digest of their spans, and all spans.

    Null and empty texts have no spans: counts of 0 and the digest of the empty string; each row of a repeated or null doc_id is told.
    """
    found = BlobLedger(docs.sparkSession, path).scan(docs, ("doc_id",))
    base = [r.kind for r in BASE.rules]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_text_of(of(*base)).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), "blob")
