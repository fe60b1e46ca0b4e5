"""Detector metrics as aggregates: error rates, thresholds, AUROC, calibration, drift, paired tests.

Rows have y (1: generated, 0: human) and s (score).  Metrics take any grouping columns, so
one pass gives all regimes; what cannot be measured is null, not 0.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.sampling import ranked_in_ranges

# Shares below this count as it; conventional drift levels; least sample sizes.
LEAST_SHARE = 1e-6
PSI_MINOR, PSI_SIGNIFICANT = 0.10, 0.25
MIN_DRIFT_ROWS = 200
CALIBRATION_BINS = 15


def false_positive_rate(threshold: float | Column, y: str = "y", s: str = "s") -> Column:
    return F.avg(F.when(F.col(y) == 0, (F.col(s) >= threshold).cast("double")))


def false_negative_rate(threshold: float | Column, y: str = "y", s: str = "s") -> Column:
    return F.avg(F.when(F.col(y) == 1, (F.col(s) < threshold).cast("double")))


def precision(threshold: float | Column, y: str = "y", s: str = "s") -> Column:
    """Share of rows at or above the threshold that are generated."""
    return F.avg(F.when(F.col(s) >= threshold, (F.col(y) == 1).cast("double")))


def threshold_at_fpr(scores: DataFrame, target_fpr: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, n_human and cut: the score that human scores must exceed for the rate to be within target_fpr.

    cut is the human score of rank ceil((1 - target) * n), kept in 1 to n; the threshold is
    the next float above it, which is the same as a strict comparison with cut.  Ranks come
    from counts of distinct scores, so no group is sorted in one task.
    """
    human = scores.where("y = 0").groupBy(*groups, "s").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked_in_ranges(human, "s", "n", groups)
    total = scores.where("y = 0").groupBy(*groups).agg(F.count(F.lit(1)).alias("n_human"))
    joined = ranked.join(total, list(groups)) if groups else ranked.crossJoin(F.broadcast(total))
    rank = F.least(F.greatest(F.ceil(F.lit(1.0 - target_fpr) * F.col("n_human")), F.lit(1)), F.col("n_human"))
    return joined.where((F.col("before") < rank) & (rank <= F.col("before") + F.col("n"))).select(*groups, "n_human", F.col("s").alias("cut"))


def auroc(scores: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, n, n_human, n_ai and auroc (ties count a half; null if a class is missing)."""
    by_score = scores.groupBy(*groups, "s").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("p"))
    ranked = ranked_in_ranges(by_score, "s", "n", groups)
    # the mean rank of a tie, for each of its generated rows
    ranks = F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2))
    pos, all_ = F.sum("p"), F.sum("n")
    found = ranked.groupBy(*groups).agg(all_.alias("n"), (all_ - pos).alias("n_human"), pos.alias("n_ai"), ranks.alias("__ranks"))
    p, h = F.col("n_ai"), F.col("n_human")
    area = F.when((p > 0) & (h > 0), (F.col("__ranks") - p * (p + 1) / 2) / (p * h))
    return found.withColumn("auroc", area).drop("__ranks")


def calibration_error(scores: DataFrame, groups: tuple[str, ...] = (), bins: int = CALIBRATION_BINS) -> DataFrame:
    """groups and ece: the mean gap of accuracy at 0.5 and confidence over bins (lo, hi] of the score, the first closed."""
    edges = [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]
    place = F.lit(None).cast("int")
    for k in range(bins - 1, -1, -1):
        inside = (F.col("s") > edges[k]) if k else (F.col("s") >= 0.0)
        place = F.when(inside & (F.col("s") <= edges[k + 1]), k).otherwise(place)
    right = ((F.col("s") >= 0.5).cast("int") == F.col("y")).cast("double")
    by_bin = scores.groupBy(*groups, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg(F.greatest("s", 1 - F.col("s"))).alias("confidence")
    )
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))) / F.sum("n")
    return by_bin.groupBy(*groups).agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))


def regime_scores(scores: DataFrame, threshold: float, fpr_budget: float, groups: tuple[str, ...] = ("regime",)) -> DataFrame:
    """One row for each regime: counts, rates at the threshold, AUROC, ECE, and whether the budget can be measured."""
    rates = scores.groupBy(*groups).agg(false_positive_rate(threshold).alias("fpr"), false_negative_rate(threshold).alias("fnr"), precision(threshold).alias("precision"))
    found = auroc(scores, groups).join(rates, list(groups)).join(calibration_error(scores, groups), list(groups))
    return found.withColumn("measurable", F.col("n_human") >= min_humans_for_fpr(fpr_budget))


def min_humans_for_fpr(budget: float, errors: int = 5) -> int:
    return math.ceil(errors / budget)


def robustness(attacked: DataFrame, clean: DataFrame) -> DataFrame:
    """attack, fnr and delta against the clean rate of the same condition; attacked and clean have condition and fnr."""
    base = clean.select("condition", F.col("fnr").alias("clean_fnr"))
    return attacked.join(base, "condition").withColumn("delta", F.col("fnr") - F.col("clean_fnr"))


def data_efficiency(improvement: float, added: int) -> float:
    if added <= 0:
        raise ValueError("examples added must be positive")
    return improvement / added


def group_aware(scored: DataFrame, order: str = "row_order") -> DataFrame:
    """group_id, y (that of the group's last row) and s (mean score): variants of a text count once."""
    return scored.groupBy("group_id").agg(F.max_by("y", order).alias("y"), F.avg("s").alias("s"))


def histogram(values: DataFrame, value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, bin and n over fixed-width bins; values outside [lo, hi] and nulls are left out, hi is in the last bin."""
    inside = values.where(F.col(value).between(lo, hi))
    place = F.least(F.floor((F.col(value) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*groups, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def drift(values: DataFrame, value: str, side: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """One row: psi, kl, means, counts, measurable and severity of `current` against `reference` (values of side)."""
    spark = values.sparkSession
    counts = histogram(values, value, bins, lo, hi, (side,)).groupBy("bin").agg(
        F.sum(F.when(F.col(side) == "reference", F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col(side) == "current", F.col("n")).otherwise(0)).alias("a")
    )
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    sums = all_bins.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share = lambda n, t: F.greatest(F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0), F.lit(LEAST_SHARE))
    shares = all_bins.crossJoin(F.broadcast(sums)).select(share("e", "te").alias("e"), share("a", "ta").alias("a"))
    a, e = F.col("a"), F.col("e")
    gaps = shares.agg(F.sum((a - e) * F.log(a / e)).alias("psi"), F.sum(a * F.log(a / e)).alias("kl"))
    of = lambda name: F.col(side) == name
    sizes = values.agg(
        F.avg(F.when(of("reference"), F.col(value))).alias("reference_mean"),
        F.avg(F.when(of("current"), F.col(value))).alias("current_mean"),
        F.count(F.when(of("reference"), 1)).alias("n_reference"),
        F.count(F.when(of("current"), 1)).alias("n_current"),
    )
    ok = (F.col("n_reference") >= MIN_DRIFT_ROWS) & (F.col("n_current") >= MIN_DRIFT_ROWS)
    found = sizes.crossJoin(F.broadcast(gaps)).withColumn("measurable", ok)
    found = found.withColumns({"psi": F.when(F.col("measurable"), F.col("psi")), "kl": F.when(F.col("measurable"), F.col("kl"))})
    level = F.when(~F.col("measurable"), "unmeasurable").when(F.col("psi") >= PSI_SIGNIFICANT, "significant").when(F.col("psi") >= PSI_MINOR, "minor").otherwise("stable")
    return found.withColumn("severity", level)


def diagnose(score_psi: float | None, input_psi: float | None) -> str:
    """Which explanation a drift of scores and of inputs supports; None is unmeasurable."""
    if score_psi is None or input_psi is None:
        return "insufficient data"
    told = {(True, False): "model or deployment", (True, True): "traffic", (False, True): "insensitive or stuck model", (False, False): "stable"}
    return told[score_psi >= PSI_MINOR, input_psi >= PSI_MINOR]


def condition_cost(scores: DataFrame, threshold: float, groups: tuple[str, ...]) -> DataFrame:
    """Rate at or above the threshold, median, nearest-rank 95th and 99th percentile, and largest score of each group; null scores are left out.

    Percentiles are ranks among counts of distinct scores, taken by ranges: no group is buffered or ordered in one task.
    """
    by = scores.where("s is not null").groupBy(*groups, "s").agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy(*[F.col(g).alias(f"__of_{g}") for g in groups]).agg(F.sum("n").alias("all"))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    ranked = ranked_in_ranges(by, "s", "n", groups).join(total, on)
    at = lambda rank: F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("n")), F.col("s")))
    n = F.col("all")
    share = lambda q: F.ceil(F.lit(q) * n)
    return ranked.groupBy(*groups).agg(
        (F.sum(F.when(F.col("s") >= threshold, F.col("n")).otherwise(0)) / F.sum("n")).alias("fpr"),
        ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median"),
        at(share(0.95)).alias("p95"), at(share(0.99)).alias("p99"), F.max("s").alias("largest"),
    )


def budget_threshold(scores: DataFrame, budget: float) -> DataFrame:
    """arm and threshold: the human score of rank floor(budget * n) + 1 from above; rows have arm, y and s."""
    human = scores.where("y = 0").groupBy("arm", "s").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked_in_ranges(human, "s", "n", ("arm",))
    total = human.groupBy("arm").agg(F.sum("n").alias("all"))
    rank = F.col("all") - F.floor(F.lit(budget) * F.col("all"))
    return ranked.join(total, "arm").where((F.col("before") < rank) & (rank <= F.col("before") + F.col("n"))).select("arm", F.col("s").alias("threshold"))


def discordant(paired: DataFrame, threshold_a: float, threshold_b: float) -> DataFrame:
    """One row: generated documents that only arm a misses (b) and that only arm b misses (c); a miss is at or below the threshold."""
    miss_a, miss_b = F.col("a") <= threshold_a, F.col("b") <= threshold_b
    return paired.where("y = 1").agg(F.count(F.when(miss_a & ~miss_b, 1)).alias("only_a"), F.count(F.when(miss_b & ~miss_a, 1)).alias("only_b"))


def mcnemar(only_a: int, only_b: int) -> dict[str, float]:
    """Continuity-corrected chi-square with its p, and the exact two-sided binomial p."""
    n = only_a + only_b
    if not n:
        return {"chi2": 0.0, "p": 1.0, "exact_p": 1.0}
    chi2 = max(0, abs(only_a - only_b) - 1) ** 2 / n
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(min(only_a, only_b) + 1))
    return {"chi2": chi2, "p": math.erfc(math.sqrt(chi2 / 2)), "exact_p": min(1.0, 2 * tail)}


#: Poisson weights above this have a chance of less than 2 ** -53, the step of the draw.
MOST_WEIGHT = 18


def bootstrap_auroc_difference(paired: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """replicate and difference of AUROC of arms a and b over Poisson resamples of rows (id, y, a, b).

    Row weights are drawn from the row's id and the replicate alone, so a replicate is the
    same however rows lie.  Draws are counted by replicate and score before anything is
    shuffled, and ranks are taken by ranges.  A replicate that drew one class alone has a
    null difference.
    """
    u = F.shiftrightunsigned(F.xxhash64("id", "replicate", F.lit(seed)), 11) / F.lit(2.0**53)
    weight, below, mass = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, MOST_WEIGHT + 1):
        below += mass
        mass /= k
        weight = F.when(u >= below, k).otherwise(weight)
    drawn = paired.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))).withColumn("w", weight).where("w > 0")

    def area(arm: str) -> DataFrame:
        by = drawn.groupBy("replicate", F.col(arm).alias("s")).agg(F.sum("w").alias("n"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("p"))
        ranks = F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2))
        ranked = ranked_in_ranges(by, "s", "n", ("replicate",)).groupBy("replicate").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), ranks.alias("r"))
        both = F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))
        return ranked.select("replicate", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / both).alias(f"auroc_{arm}"))

    return area("a").join(area("b"), "replicate").select("replicate", (F.col("auroc_a") - F.col("auroc_b")).alias("difference"))


def fit_temperature(logits: DataFrame, lo: float = 0.05, hi: float = 10.0, rounds: int = 6, grid: int = 24) -> tuple[float, bool]:
    """The softmax temperature of least negative log-likelihood, and whether it is at a bound.

    Rows have logits (array) and y.  Every round evaluates a grid of temperatures in one
    aggregate and narrows to the best one's neighbours.
    """
    low, high = lo, hi
    best = lo
    for _ in range(rounds):
        points = [float(x) for x in np.linspace(low, high, grid)]
        top = F.array_max("logits")

        def loss(t: float) -> Column:
            total = F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / t))
            return F.avg(F.log(total) - (F.element_at("logits", F.col("y").cast("int") + 1) - top) / t)

        row = logits.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(points)]).first()
        k = int(np.argmin([row[f"t{k}"] for k in range(grid)]))
        best = points[k]
        low, high = points[max(0, k - 1)], points[min(grid - 1, k + 1)]
    return best, best - lo < 1e-3 or hi - best < 1e-3


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    z = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp((v - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def require_polarity(scored: DataFrame, margin: float = 0.05) -> None:
    """Raise unless generated rows score higher than human ones by more than margin."""
    row = scored.agg(F.avg(F.when(F.col("y") == 1, F.col("s"))).alias("ai"), F.avg(F.when(F.col("y") == 0, F.col("s"))).alias("human")).first()
    if row["ai"] is None or row["human"] is None:
        raise ValueError("polarity needs both classes")
    if row["ai"] <= row["human"] + margin:
        raise ValueError(f"generated rows score {row['ai']:.4f}, human rows {row['human']:.4f}")
