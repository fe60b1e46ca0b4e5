"""Attacks under conditions: what each deployment's preprocessing makes of perturbed texts, of clean ones, and of human ones.

All is one scan: every text is perturbed, judged, put through the conditions and scored in
its row, and rows leave it as counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import attacks as A
from textmill.functions import text as T
from textmill.operators import metrics

# attack_table works these forms out together, by attacks.judged_matrix()
#: What a deployment may do to a text before it scores it; normalised is what one does by default.
CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "raw": lambda t: t,
    "normalised": lambda t: T.normalize(t),
    "folded": lambda t: T.normalize(t, fold_confusables=True),
    "casefolded": lambda t: F.lower(T.normalize(t, fold_confusables=True)),
}
DEFAULT = ("raw", "normalised")
#: A score of a text column: an expression, or a pandas function over an injected model.
Score = Callable[[Column], Column]


def _known(conditions: tuple[str, ...]) -> None:
    unknown = sorted(set(conditions) - set(CONDITIONS))
    if unknown or "normalised" not in conditions:
        raise ValueError(f"unknown conditions {unknown}" if unknown else "the normalised condition is what deltas are stated against")


def _forms(raw: str, conditions: tuple[str, ...]) -> dict[str, Column]:
    """What CONDITIONS make of column raw, from the columns of attacks.judged_matrix()."""
    forms = {"raw": F.col(raw), "normalised": F.col("normalised"), "folded": F.col("folded"), "casefolded": F.lower("folded")}
    return {c: forms[c] for c in conditions}


def _miss(form: Column, score: Score, threshold: float, condition: str) -> Column:
    return (score(form) < threshold).cast("double").alias(f"missed_{condition}")


def attack_table(generated: DataFrame, score: Score, threshold: float, *, conditions: tuple[str, ...] = DEFAULT, attacks: dict[str, tuple[float, ...]] = A.SEVERITIES) -> DataFrame:
    """attack, severity, condition, n_scored, fnr, clean_fnr, delta, n_noop and n_invalid over generated texts (doc_id, text).

    fnr is the share of changed texts that still mean the same and score under the
    threshold; clean_fnr that of all unchanged texts under the same condition, and delta
    their difference.  Texts that an attack leaves as they were (n_noop), and those that it
    makes mean something else (n_invalid), count in no rate; an attack without any other
    has the clean rate.  Null texts are left out; null scores count in no rate.
    """
    _known(conditions)
    real = generated.where(F.col("text").isNotNull())
    folds = bool({"folded", "casefolded"} & set(conditions))
    made = A.judged_matrix(real.select("doc_id", "text"), attacks, folds=folds)
    # what is no change, or known to mean something else, is not scored
    scored = F.coalesce("valid", F.lit(True)) & ~F.col("noop")
    missed = [_miss(F.when(scored, form), score, threshold, c) for c, form in _forms("attacked", conditions).items()]
    kept = A.settled(made.select("attack", "severity", "noop", "valid", "known", "plain", *missed)).withColumn("valid", ~F.col("noop") & F.col("valid"))
    counts = kept.groupBy("attack", "severity").agg(
        F.count(F.when(F.col("valid"), 1)).alias("n_scored"), F.count(F.when(F.col("noop"), 1)).alias("n_noop"), F.count(F.when(~F.col("noop") & ~F.col("valid"), 1)).alias("n_invalid"),
        *[F.avg(F.when(F.col("valid"), F.col(f"missed_{c}"))).alias(f"fnr_{c}") for c in conditions],
    )
    unchanged = A.normal_forms(real, folds=folds)
    clean = unchanged.select(*[_miss(form, score, threshold, c) for c, form in _forms("text", conditions).items()]).agg(*[F.avg(f"missed_{c}").alias(c) for c in conditions]).first()
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"fnr_{c}").alias("fnr"), F.lit(clean[c]).cast("double").alias("clean_fnr")) for c in conditions]))
    rows = counts.select("attack", "severity", "n_scored", "n_noop", "n_invalid", each.alias("x")).withColumn("fnr", F.coalesce("x.fnr", "x.clean_fnr"))
    return rows.select("attack", "severity", "x.condition", "n_scored", "fnr", "x.clean_fnr", (F.col("fnr") - F.col("x.clean_fnr")).alias("delta"), "n_noop", "n_invalid")


def human_cost(human: DataFrame, score: Score, threshold: float, conditions: tuple[str, ...] = DEFAULT) -> DataFrame:
    """condition, n_human, fpr, median, p95, p99 and largest of human texts' scores: the price of a condition, which a lower miss rate alone does not tell."""
    _known(conditions)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), score(CONDITIONS[c](F.col("text"))).alias("s")) for c in conditions]))
    scores = human.where(F.col("text").isNotNull()).select(each.alias("x")).select("x.condition", "x.s")
    sizes = scores.where("s is not null").groupBy("condition").agg(F.count(F.lit(1)).alias("n_human"))
    return metrics.condition_cost(scores, threshold, ("condition",)).join(sizes, "condition")


def headline(regimes: DataFrame, iid: str = "R1_iid", unseen: str = "R3_unseen_generator", adversarial: str = "R5_adversarial") -> DataFrame:
    """One row from named regimes of metrics.regime_scores: human_fpr, ai_fnr and ece of the first, ood_auroc of the second, adversarial_fnr of the third; null where a regime is missing."""
    of = lambda name, column: F.max(F.when(F.col("regime") == name, F.col(column)))
    return regimes.agg(of(iid, "fpr").alias("human_fpr"), of(iid, "fnr").alias("ai_fnr"), of(unseen, "auroc").alias("ood_auroc"), of(adversarial, "fnr").alias("adversarial_fnr"), of(iid, "ece").alias("ece"))
