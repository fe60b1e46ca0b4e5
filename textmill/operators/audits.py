"""Audits between sets of documents: contamination, leakage, regimes, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import hashing as H
from textmill.functions import text as T
from textmill.operators import dedup
from textmill.operators.tables import bound_batches, checkpointed, require_empty

CONTAMINATION_THRESHOLD = 0.5
# Prompt families that each arm may train on.
ARM_PROMPTS = {"random": "random", "mirror": "mirror", "hard_negative": "mirror"}


def canonical_hash(text: Column | str) -> Column:
    return H.sha256(T.normalize(text))


def exact_overlap(train: DataFrame, evaluation: DataFrame, *, normalise: bool = True) -> DataFrame:
    """doc_id of evaluation texts that training holds too, with the smallest such train_id."""
    bound_batches(train.sparkSession)
    key = canonical_hash("text") if normalise else H.sha256("text")
    known = train.groupBy(key.alias("h")).agg(F.min("doc_id").alias("train_id"))
    return evaluation.withColumn("h", key).join(known, "h").select("doc_id", "train_id")


def _signed(docs: DataFrame, params: dedup.LshParams, what: str) -> DataFrame:
    """doc_id, h (the canonical hash) and signature: each text is normalised, hashed and signed once, and what is read again is written without it."""
    clean = docs.select("doc_id", T.normalize("text").alias("text")).withColumn("h", H.sha256("text"))
    return checkpointed(dedup.signatures(clean, params, digest="h").withColumnRenamed("digest", "h"), what)


def contamination(train: DataFrame, evaluation: DataFrame, threshold: float = CONTAMINATION_THRESHOLD) -> DataFrame:
    """doc_id, kind (exact or near), train_id and jaccard: one row for each evaluation document that training holds or resembles.

    Bands join classes of equal signatures, not documents; of several hits the most
    similar is told, then the smallest id.  Null texts equal and resemble nothing; texts
    without words may be equal, but resemble nothing.
    """
    params = dedup.LshParams(threshold=threshold)
    items, known = _signed(evaluation, params, "evaluation-signed"), _signed(train, params, "train-signed")
    first = known.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("train_id"))
    told = items.join(first, "h", "left")
    exact = told.where("train_id is not null").select("doc_id", F.lit("exact").alias("kind"), "train_id", F.lit(1.0).alias("jaccard"))
    rest = told.where(F.col("train_id").isNull() & dedup.has_words()).select("doc_id", "signature")
    heads = dedup.classes(rest)
    pairs = dedup.similar_pairs(heads, dedup.classes(known.where(dedup.has_words()).select("doc_id", "signature")), params)
    best = pairs.groupBy("a").agg(F.max("jaccard").alias("jaccard"), F.min_by("b", F.struct(-F.col("jaccard"), "b")).alias("train_id"))
    led = rest.join(heads.withColumnRenamed("doc_id", "a"), "signature").select("doc_id", "a").join(best, "a")
    return exact.unionByName(led.select("doc_id", F.lit("near").alias("kind"), "train_id", "jaccard"))


def require_clean(found: DataFrame, name: str) -> None:
    require_empty(found, f"{name} is contaminated")


def leaking_groups(rows: DataFrame, group: str = "source_group_id", split: str = "split") -> DataFrame:
    """Groups in more than one split."""
    ends = rows.groupBy(group).agg(F.min(split).alias("first"), F.max(split).alias("last"))
    return ends.where("first != last").select(group)


def require_no_leakage(rows: DataFrame, group: str = "source_group_id") -> None:
    require_empty(leaking_groups(rows, group), "groups in several splits")


def require_disjoint(reserve: DataFrame, training_groups: DataFrame, group: str = "source_group_id") -> None:
    require_empty(reserve.join(training_groups.select(group), group, "left_semi").select(group), "groups of training in the reserve")


def require_inherited(humans: DataFrame, mirrors: DataFrame) -> None:
    """Mirrors must have the split and group of a human source that exists."""
    h = humans.select(F.col("doc_id").alias("source_human_id"), F.col("split").alias("hs"), F.col("source_group_id").alias("hg"))
    joined = mirrors.join(h, "source_human_id", "left")
    require_empty(joined.where("hs is null or split != hs or source_group_id != hg").select("sample_id"), "mirrors that do not inherit")


def require_arm(samples: DataFrame, arm: str) -> None:
    """All prompt versions must be one of the arm's family."""
    family = ARM_PROMPTS.get(arm)
    if family is None:
        return
    version = F.coalesce("prompt_version", F.lit("unknown"))
    require_empty(samples.where(~version.rlike(rf"\A{family}_v\d+\z")).select("prompt_version").distinct(), f"arm {arm} holds other prompts")
    ends = samples.agg(F.min(version).alias("first"), F.max(version).alias("last"))
    require_empty(ends.where("first != last"), f"arm {arm} mixes prompt versions")


def require_both_classes(rows: DataFrame, split: str) -> None:
    if rows.where(F.col("split") == split).select("label").distinct().count() < 2:
        raise ValueError(f"{split} lacks a class")


def arms_comparable(a: DataFrame, b: DataFrame, treatment: Column) -> bool:
    """Whether two arms share their other rows and have equally many treated ones, above none."""
    na, nb = a.where(treatment).count(), b.where(treatment).count()
    same = a.where(~treatment).exceptAll(b.where(~treatment)).isEmpty() and b.where(~treatment).exceptAll(a.where(~treatment)).isEmpty()
    return na == nb > 0 and same


def group_keys(rows: DataFrame, key: Column, group: str, order: str, neutral: str = "") -> DataFrame:
    """group and key: that of the first row (by order) that is not neutral, else neutral."""
    real = F.when(key != neutral, key)
    return rows.groupBy(group).agg(F.coalesce(F.min_by(real, F.when(real.isNotNull(), F.col(order))), F.lit(neutral)).alias("regime_key"))


def regime(rows: DataFrame, key: Column, is_test, group: str = "source_group_id", order: str = "doc_id", neutral: str = "") -> DataFrame:
    """rows with side (train or test), told by the key of the row's whole group."""
    keys = group_keys(rows, key, group, order, neutral)
    return rows.join(keys, group).withColumn("side", F.when(is_test(F.col("regime_key")), "test").otherwise("train")).drop("regime_key")


def unseen_domain(rows: DataFrame, domains: list[str], **options) -> DataFrame:
    return regime(rows, F.col("domain"), lambda k: k.isin(*domains), **options)


def unseen_generator(rows: DataFrame, families: list[str], **options) -> DataFrame:
    if "human" in families:
        raise ValueError("human is no generator")
    return regime(rows, F.col("generator_family"), lambda k: k.isin(*families), neutral="human", **options)


def temporal(rows: DataFrame, cutoff: str, **options) -> DataFrame:
    """Groups released after the cutoff (ISO dates, compared as texts) are the test side."""
    return regime(rows, F.coalesce("generator_released", F.lit("")), lambda k: k > cutoff, **options)


def require_sides(rows: DataFrame) -> None:
    if rows.select("side").distinct().count() < 2:
        raise ValueError("a side of the regime is empty")


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """column, value and n, for each of the columns."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(parts.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
