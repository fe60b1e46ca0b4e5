"""Ties, guards and nulls: results must not hang on how rows lie, or on which columns are read."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import audits, decisions, mining, sampling
from textmill.sources import readers


def test_selection_of_ties_is_the_same_for_any_partitioning(spark):
    rows = [(i, i % 4, 0.9) for i in range(2000)]
    df = spark.createDataFrame(rows, "sample_id long, cluster int, confidence double")
    chosen = [{r.sample_id for r in sampling.select_proportional(df.repartition(n, F.rand(n)), budget=200).collect()} for n in (3, 7)]
    assert chosen[0] == chosen[1]
    named = df.withColumns({c: F.lit("x") for c in ("domain", "source", "register")})
    summaries = [{r.cluster: r.exemplars for r in mining.cluster_summary(named.repartition(n, F.rand(n))).collect()} for n in (2, 5)]
    assert summaries[0] == summaries[1] and summaries[0][1] == [1, 5, 9, 13, 17]


@pytest.mark.parametrize("prefix", ["src1_", ""])
def test_numbered_ranks_strings_numbers_and_null_groups(spark, prefix):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), f"{prefix}{rng.randrange(10**6):06d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o string, id long")
    got = {r.id: r.place for r in sampling.numbered(df.repartition(5), "g", "o", "place", ties=("id",)).collect()}
    want = {}
    for g in ("a", "b", None):
        for k, (_, i) in enumerate(sorted((o, i) for h, o, i in rows if h == g)):
            want[i] = k + 1
    assert got == want
    # no range holds more than a fair share, even of ids that begin alike
    equal = df.withColumn("o", F.lit("same")).withColumn("g", F.lit("a")).repartitionByRange(8, "g", "o", "id")
    assert max(r[1] for r in equal.groupBy(F.spark_partition_id()).count().collect()) < 1000


@pytest.mark.parametrize("score", [float("nan"), 7.0, -1.0])
@pytest.mark.parametrize("field", ["verdict", "confidence", "abstained"])
def test_decide_fails_on_what_is_no_probability(spark, score, field):
    for policy in (decisions.Policy(0.5), decisions.Policy(0.5, 0.4, 0.6)):
        df = spark.createDataFrame([(score,)], "s double").select(decisions.decide("s", policy).alias("d")).select(f"d.{field}")
        with pytest.raises(Exception, match="not a probability"):
            df.collect()
    nulls = spark.createDataFrame([(None,)], "s double").select(decisions.decide("s", decisions.Policy(0.5, 0.4, 0.6)).alias("d")).select("d.*").first()
    assert list(nulls) == [None, None, None]


def test_contamination_of_planted_texts(spark):
    words = [f"w{i}" for i in range(300)]
    base, other = " ".join(words[:120]), " ".join(words[150:270])
    near = base.replace("w60 ", "changed ")
    train = spark.createDataFrame([(1, base), (2, base), (3, None), (4, ""), (5, "???"), (6, " ".join(words[100:220]))], "doc_id long, text string")
    items = spark.createDataFrame([(10, base), (11, near), (12, other), (13, None), (14, ""), (15, "!!!"), (16, f"  {base}  "), (17, "")], "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.train_id): r.jaccard for r in audits.contamination(train, items).collect()}
    assert {k for k in got if k[1] == "exact"} == {(10, "exact", 1), (16, "exact", 1), (14, "exact", 4), (17, "exact", 4)}
    assert {k for k in got if k[1] == "near"} == {(11, "near", 1)} and 0.7 < got[11, "near", 1] < 1
    assert audits.contamination(train.limit(0), items).collect() == [] and audits.contamination(train, items.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page, want",
    [
        ("<HTML><HEAD><TITLE>Title</TITLE></HEAD><BODY><p>Hi</BODY></HTML>", "Hi"),
        ("<body><div><nav>menu<div>more</div></div><p>text<p>end</body>", "text\nend"),
        ("<body><header>top<main>inside</main> after</body>", "inside\nafter"),
        ("<body><nav>a<nav>b</nav>c</nav>d<script>x<y</script>e", "d\ne"),
        ("plain <b>bold</b>", "plain\nbold"),
        ("<p>a<br>b</p></div>c<footer>d</footer>", "a\nb\nc"),
        ("", ""),
        (None, None),
    ],
)
def test_visible_text(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(readers.html_text("h").alias("t")).first().t == want
