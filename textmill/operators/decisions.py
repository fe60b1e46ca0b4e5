"""Verdicts with an uncertain band, the band from validation scores, and the release gate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import _col
from textmill.operators.metrics import threshold_at_fpr
from textmill.operators.sampling import ranked_in_ranges


@dataclass(frozen=True)
class Policy:
    """A threshold and, if both are given, the band from low (included) to high (not) without a verdict."""

    threshold: float
    low: float | None = None
    high: float | None = None

    def __post_init__(self) -> None:
        if not 0.0 < self.threshold < 1.0:
            raise ValueError(f"the threshold {self.threshold} is not between 0 and 1")
        if (self.low is None) != (self.high is None):
            raise ValueError("a band has two ends")
        if self.low is not None and not 0.0 <= self.low <= self.threshold <= self.high <= 1.0:
            raise ValueError(f"the band {self.low} to {self.high} must hold the threshold {self.threshold}, within 0 to 1")


def decide(score: Column | str, policy: Policy) -> Column:
    """struct(verdict, confidence, abstained).

    verdict is ai, human or uncertain; confidence is the distance from the threshold as a
    share of the largest there can be.  A null score gives nulls; one that is no
    probability (NaN too) fails the job.
    """
    s, t = _col(score), policy.threshold
    sound = F.when(s.isNull() | s.between(0.0, 1.0), s).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), s.cast("string"))))
    # all fields are made from the guarded score, as a query may read any of them alone
    within = F.lit(False) if policy.low is None else (sound >= policy.low) & (sound < policy.high)
    verdict = F.when(sound.isNull(), None).when(within, "uncertain").when(sound >= t, "ai").otherwise("human")
    return F.struct(verdict.alias("verdict"), (F.abs(sound - t) / max(t, 1 - t)).alias("confidence"), F.when(sound.isNotNull(), within).alias("abstained"))


def band(scores: DataFrame, fpr_budget: float, share: float = 0.02) -> tuple[float, float, float]:
    """(threshold, low, high) of validation scores (y, s): a band over `share` of the rows around the threshold.

    The threshold keeps the false-positive rate within the budget.  Ends are the scores
    half the band's rows below and above it, one row at least, found by ranks of distinct
    scores; only these few numbers reach the driver.  share 0 gives an empty band.  Rows
    with a null score are left out; without human rows there is no threshold (ValueError).
    """
    if not 0.0 <= share < 1.0:
        raise ValueError("share must be at least 0 and under 1")
    real = scores.where("s is not null")
    cut = threshold_at_fpr(real, fpr_budget).first()
    if cut is None:
        raise ValueError("no human scores")
    threshold = float(np.nextafter(cut["cut"], np.inf))
    if share == 0.0:
        return threshold, threshold, threshold
    n, under = real.agg(F.count(F.lit(1)), F.count(F.when(F.col("s") < threshold, 1))).first()
    half = max(int(n * share / 2), 1)
    ranks = ranked_in_ranges(real.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", "n")
    at = lambda k: F.max(F.when((F.col("before") <= k) & (F.lit(k) < F.col("before") + F.col("n")), F.col("s")))
    low, high = ranks.agg(at(max(under - half, 0)), at(min(under + half, n - 1))).first()
    return threshold, min(low, threshold), max(high, threshold)


def gate_failures(metrics: DataFrame, rules: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, rule, value, bound and failure of each rule that a model breaks; no row means that it may be released.

    metrics and baseline hold metric and value; rules hold metric, rule and bound, where
    rule is most, least, or no_regression (the bound is then the baseline's value, and
    more is better).  A metric that is missing, or a value or bound that is null, NaN or
    infinite, is a failure, never a pass.
    """
    now = metrics.select("metric", F.col("value").cast("double").alias("value"), F.lit(True).alias("__has"))
    before = baseline.select("metric", F.col("value").cast("double").alias("__before"), F.lit(True).alias("__had"))
    regression = F.col("rule") == "no_regression"
    both = rules.join(now, "metric", "left").join(before, "metric", "left").withColumn("bound", F.when(regression, F.col("__before")).otherwise(F.col("bound").cast("double")))
    unsound = lambda c: F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    failure = (
        F.when(regression & F.col("__had").isNull(), "missing_baseline").when(F.col("__has").isNull(), "missing_metric")
        .when(unsound("value"), "metric_not_finite").when(unsound("bound"), "bound_not_finite")
        .when((F.col("rule") == "most") & (F.col("value") > F.col("bound")), "above_bound")
        .when((F.col("rule") == "least") & (F.col("value") < F.col("bound")), "below_bound")
        .when(regression & (F.col("value") < F.col("bound")), "regression")
        .when(~F.col("rule").isin("most", "least", "no_regression"), "unknown_rule")
    )
    return both.withColumn("failure", failure).where("failure is not null").select("metric", "rule", "value", "bound", "failure")
