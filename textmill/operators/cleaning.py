"""The cleaning funnel: one pass of expressions over raw records, then global deduplication.

Raw records have source_id, source_record_id, text, license, domain, register, date and,
where they are known, upstream (struct of language and score) and edu_score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import hashing as H
from textmill.functions import text as T
from textmill.operators import dedup
from textmill.operators.tables import bound_batches, checkpointed

PROCESSING_VERSION = "clean_v1"


@dataclass(frozen=True)
class CleaningPolicy:
    length: T.LengthPolicy = field(default_factory=T.LengthPolicy)
    quality: T.QualityPolicy = field(default_factory=T.QualityPolicy)
    language: str = "en"
    language_score_min: float = 0.85
    redistributable: tuple[str, ...] = ("public-domain-us", "public-domain-us-gov", "synthetic")


#: Columns that a raw record may leave out, with their types.
OPTIONAL = {
    "source_config": "string",
    "license": "string",
    "domain": "string",
    "register": "string",
    "date": "string",
    "acquired_at": "timestamp",
    "upstream": "struct<language:string,score:double>",
    "edu_score": "double",
}


def with_optional(records: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in records.columns}
    return records.withColumns(missing) if missing else records


def judge(records: DataFrame, policy: CleaningPolicy = CleaningPolicy(), *, normalise: bool = True, redact: bool = True) -> DataFrame:
    """Every record with its cleaned text, language, flags and reject_reason (null: kept so far).

    Stages: schema, normalisation, length, language, quality, personal data, length again.
    The first that fails gives the reason.  Null and empty texts and ids fail the schema.
    """
    bound_batches(records.sparkSession)
    records = with_optional(records)
    missing = F.col("text").isNull() | (F.col("text") == "") | F.col("source_record_id").isNull() | (F.col("source_record_id").cast("string") == "")
    text = F.coalesce(F.col("text"), F.lit(""))
    first = records.withColumn("__missing", missing).withColumn("text", T.normalize(text, once=True) if normalise else text)
    # each stage is a projection of its own, so that what several stages read is computed once
    lang = T.language("text", F.col("upstream"))
    first = first.withColumns({"__lang": lang, "__tokens": T.token_count("text")})
    wrong = (F.col("__lang.language") != policy.language) | (F.col("__lang.score") < policy.language_score_min)
    early = [
        (F.col("__missing"), "empty_or_unidentified"),
        (F.col("text") == "", "empty_after_normalization"),
        *T.length_reasons("text", "__tokens", policy.length),
        (F.coalesce(wrong, F.lit(True)), "language"),
    ]
    # only texts that come so far are measured
    first = first.withColumn("__early", T.first_reason(early)).withColumn("__quality", F.when(F.col("__early").isNull(), T.quality("text")))
    judged = first.withColumn("reject_reason", F.coalesce("__early", T.first_reason(T.quality_reasons("__quality", policy.quality))))
    if redact:
        judged = T.with_redacted(judged, "text", "__redacted").withColumn("text", F.col("__redacted.text"))
        judged = judged.withColumn("__tokens", T.token_count("text"))
        again = T.first_reason([(c, f"{n}_after_redaction") for c, n in T.length_reasons("text", "__tokens", policy.length)])
        judged = judged.withColumn("reject_reason", F.coalesce("reject_reason", again))
        flags = F.col("__redacted.flags")
    else:
        flags = F.array().cast("array<string>")
    return judged.select(
        *[c for c in records.columns if c != "text"],
        "text",
        F.col("__lang.language").alias("language"),
        F.col("__lang.score").alias("language_score"),
        flags.alias("pii_flags"),
        "reject_reason",
    )


def record_id() -> Column:
    """The doc_id of a raw record."""
    return F.concat_ws("_", F.col("source_id").cast("string"), F.col("source_record_id").cast("string"))


def funnel_counts(judged: DataFrame) -> DataFrame:
    """reason, split and n: documents by the reason of their rejection (split null), and kept ones by split, one of each content.

    Records are judged in one scan, of which only ids, reasons and hashes are written; the
    smallest id of each content is an aggregate, and its split is a function of it.
    """
    rows = checkpointed(judged.select("reject_reason", record_id().alias("doc_id"), F.when(F.col("reject_reason").isNull(), H.sha256("text")).alias("content_sha256")), "funnel")
    first = rows.where("reject_reason is null").groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"))
    kept = first.groupBy(F.lit("kept").alias("reason"), H.split_of(H.group_id("doc_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    gone = rows.where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason"), F.lit(None).cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(gone)


def documents_of(judged: DataFrame, policy: CleaningPolicy = CleaningPolicy()) -> DataFrame:
    """Kept records as corpus rows; ids, hash, token count and split are functions of the record."""
    kept = judged.where("reject_reason is null").drop("reject_reason")
    kept = kept.withColumn("doc_id", record_id()).withColumn("source_group_id", H.group_id("doc_id"))
    return kept.select(
        "doc_id",
        "source_group_id",
        "text",
        F.col("source_id").cast("string").alias("source"),
        "source_config",
        F.col("source_record_id").cast("string").alias("source_record_id"),
        "license",
        "domain",
        "register",
        "language",
        "language_score",
        "date",
        "acquired_at",
        F.lit(PROCESSING_VERSION).alias("processing_version"),
        H.sha256("text").alias("content_sha256"),
        T.token_count("text").alias("token_count"),
        F.struct("edu_score", F.lit(True).alias("length_ok"), "pii_flags").alias("quality"),
        H.split_of("source_group_id").alias("split"),
        F.coalesce(F.col("license").isin(*policy.redistributable), F.lit(False)).alias("redistributable"),
    )


def clean(records: DataFrame, policy: CleaningPolicy = CleaningPolicy(), *, near: bool = False, order: str = "doc_id") -> DataFrame:
    """Corpus rows after cleaning and deduplication: the smallest `order` of each content stays.

    near adds the greedy near-duplicate pass (see dedup.near_duplicates).
    """
    # written, so that filters below do not judge (and normalise) every record again
    docs = documents_of(checkpointed(judge(records, policy), "clean-judged"), policy)
    docs = dedup.first_of_content(docs, order=order)
    return dedup.without_near_duplicates(docs, order=order) if near else docs


def reject_counts(judged: DataFrame) -> DataFrame:
    """Documents by the reason of their rejection; kept ones have the reason ``kept``."""
    return judged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def cleaning_stats(judged: DataFrame) -> DataFrame:
    """One row: seen, kept, keep_rate (four digits)."""
    kept = F.count(F.when(F.col("reject_reason").isNull(), 1))
    seen = F.count(F.lit(1))
    rate = F.when(seen == 0, 0.0).otherwise(F.bround(kept / seen, 4))
    return judged.agg(seen.alias("seen"), kept.alias("kept"), rate.alias("keep_rate"))


def require_policy(docs: DataFrame, policy: CleaningPolicy) -> None:
    """Raise if a row's token count is outside the policy."""
    outside = docs.where(~F.col("token_count").between(policy.length.min_tokens, policy.length.max_tokens))
    if not outside.isEmpty():
        raise ValueError("documents outside the length policy")


def quotas(shares: dict[str, float], total: int | None) -> dict[str, int | None]:
    """Rows that each source may give, rounded half to even."""
    return {s: None if total is None else round(total * share) for s, share in shares.items()}


def train_and_reserve(docs: DataFrame, wanted: dict[str, int], order: Column | str = "doc_id") -> DataFrame:
    """docs with pool: train for the first rows of each source up to its quota, reserve for the rest."""
    from textmill.operators.sampling import numbered

    quota = F.create_map(*[F.lit(x) for s, n in wanted.items() for x in (s, n)])
    rank = numbered(docs, "source", order, "__place")
    pool = F.when(F.col("__place") <= F.coalesce(F.element_at(quota, F.col("source")), F.lit(0)), "train").otherwise("reserve")
    return rank.withColumn("pool", pool).drop("__place")
