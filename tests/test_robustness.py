"""Attack tables under conditions against their own rows, one by one."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import attacks as A
from textmill.functions import text as T
from textmill.operators import metrics, robustness
from textmill.operators.dedup import texts_resemble

TEXTS = [
    (i, " ".join(f"The {w} house stood near a big river because many people use it {i}." for w in ("old", "small", "new", "red", "tall", "blue", "grey", "long")) + (" And quickly." if i % 2 else "")) for i in range(30)
] + [(100, None), (101, ""), (102, "short"), (103, "UPPER CASE ONLY " * 20)]


def _score(t):
    return F.length(F.regexp_replace(t, r"[^A-Za-z ]", "")) % 17 / 17.0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def test_attack_table_is_that_of_its_rows(docs):
    conditions = ("raw", "normalised", "folded", "casefolded")
    got = {(r.attack, r.severity, r.condition): r for r in robustness.attack_table(docs, _score, 0.5, conditions=conditions).collect()}
    assert len(got) == 4 * sum(len(s) for s in A.SEVERITIES.values())
    made = A.attack_matrix(docs.where("text is not null")).withColumn("valid", A.preserves_meaning("text", "attacked"))
    forms = {"raw": F.col("attacked"), "normalised": T.normalize("attacked"), "folded": T.normalize("attacked", fold_confusables=True), "casefolded": F.lower(T.normalize("attacked", fold_confusables=True))}
    rows = made.select("attack", "severity", "valid", (F.col("text") == F.col("attacked")).alias("noop"), *[_score(c).alias(n) for n, c in forms.items()]).collect()
    clean = {n: docs.where("text is not null").select((_score(robustness.CONDITIONS[n](F.col("text"))) < 0.5).cast("double").alias("m")).agg(F.avg("m")).first()[0] for n in conditions}
    for (attack, severity, condition), r in got.items():
        mine = [x for x in rows if x.attack == attack and x.severity == severity]
        kept = [x[condition] < 0.5 for x in mine if not x.noop and x.valid]
        assert (r.n_scored, r.n_noop, r.n_invalid) == (len(kept), sum(x.noop for x in mine), sum(not x.noop and not x.valid for x in mine))
        assert r.clean_fnr == pytest.approx(clean[condition]) and r.fnr == pytest.approx(sum(kept) / len(kept) if kept else clean[condition])
        assert r.delta == pytest.approx(r.fnr - r.clean_fnr)
    # folding undoes look-alikes, normalisation invisible characters
    assert all(got["homoglyph_substitute", 0.2, c].delta == pytest.approx(0, abs=0.2) for c in ("folded",))
    assert got["zero_width_insert", 0.05, "normalised"].n_scored > 25


def test_conditions_are_checked(docs):
    for bad in (("raw",), ("normalised", "upside_down")):
        with pytest.raises(ValueError):
            robustness.attack_table(docs, _score, 0.5, conditions=bad)
    assert robustness.attack_table(docs.limit(0), _score, 0.5).collect() == []


def test_human_cost(docs):
    got = {r.condition: r for r in robustness.human_cost(docs, _score, 0.5).collect()}
    scores = sorted(r.s for r in docs.where("text is not null").select(_score(F.col("text")).alias("s")).collect())
    n, r = len(scores), got["raw"]
    import math
    import statistics

    assert r.n_human == n and r.fpr == pytest.approx(sum(s >= 0.5 for s in scores) / n) and r.median == pytest.approx(statistics.median(scores))
    assert (r.p95, r.p99, r.largest) == (scores[math.ceil(0.95 * n) - 1], scores[math.ceil(0.99 * n) - 1], scores[-1])


@pytest.mark.parametrize("n", [1, 2, 7, 20, 100])
def test_percentiles_by_ranges(spark, n):
    rows = [(None if k % 2 else "a", float(k * 37 % n)) for k in range(2 * n)] + [("a", None)]
    got = {r.g: r for r in metrics.condition_cost(spark.createDataFrame(rows, "g string, s double"), 3.0, ("g",)).collect()}
    import math
    import statistics

    for g in ("a", None):
        mine = sorted(s for h, s in rows if h == g and s is not None)
        r = got[g]
        assert r.median == statistics.median(mine) and r.p95 == mine[math.ceil(0.95 * len(mine)) - 1] and r.largest == mine[-1] and r.fpr == pytest.approx(sum(s >= 3 for s in mine) / len(mine))


def test_headline(spark):
    rows = [("R1_iid", 0.01, 0.1, 0.99, 0.02), ("R3_unseen_generator", 0.02, 0.3, 0.8, 0.1)]
    got = robustness.headline(spark.createDataFrame(rows, "regime string, fpr double, fnr double, auroc double, ece double")).first()
    assert got.asDict() == {"human_fpr": 0.01, "ai_fnr": 0.1, "ood_auroc": 0.8, "adversarial_fnr": None, "ece": 0.02}


def test_resemblance_of_equal_and_empty_texts(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(long, long, True), (long, long + " more", True), (long, "other words here entirely", False), ("", "", False), ("", long, False), (long, "", False)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "a string, b string, want boolean, k int").coalesce(1)
    assert all(r.got == r.want for r in df.select("want", texts_resemble("a", "b", F.lit(0.5)).alias("got")).collect())


def test_bootstrap_of_paired_arms(spark):
    import random

    rng = random.Random(3)
    rows = [(i, i % 2, (i % 2) * 0.8 + rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = sorted((r.replicate, r.difference) for r in metrics.bootstrap_auroc_difference(df.repartition(3), 40).collect())
    again = sorted((r.replicate, r.difference) for r in metrics.bootstrap_auroc_difference(df.repartition(5), 40).collect())
    assert [k for k, _ in got] == list(range(40)) and [d for _, d in got] == pytest.approx([d for _, d in again])

    def area(s):
        pos, neg = [r[s] for r in rows if r[1]], [r[s] for r in rows if not r[1]]
        return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))

    differences = [d for _, d in got]
    mean = sum(differences) / 40
    assert mean == pytest.approx(area(2) - area(3), abs=0.02) and 0.005 < max(differences) - min(differences) < 0.3
    one = metrics.bootstrap_auroc_difference(df.where("y = 1"), 2).collect()
    assert all(r.difference is None for r in one)
