"""Attacked texts in one pass: the same rows as one by one, and none that wait on disk for Python."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import attacks as A
from textmill.functions import text as T
from textmill.plans import catalogue

SENTENCE = "The big river is near a house. Many people use it often, because they need help. "
TEXTS = [SENTENCE * 6, f"<p>{SENTENCE * 4}</p> [here](http://x) &amp; &lt;b&gt; more", "ﬁne\xa0 Неllо ​world о̆ \t\n \n\n\n " + SENTENCE * 3, "Один большой дом. " * 9, "see ]a(b) [x" + SENTENCE, "", " ", "one", None]


@pytest.mark.parametrize("query", ["attack_report", "attack_conditions"])
def test_no_rows_wait_for_columns_from_python(spark, tiny, query):
    plan = getattr(catalogue, query)(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan


def test_texts_are_smoothed_as_spark_normalises(spark):
    rng = random.Random(4)
    parts = [*T.SPACES, *T.INVISIBLE, "  ", "\n\n\n", "\n \n", " \n", "a", "Bc", "ﬁ", "é", "é", "о", "Ж", "α", "中", "<b>", "<", "](u)", "[t", "&amp;", "&", ";", "<script>", "</script>"]
    texts = ["".join(rng.choices(parts if k % 3 else parts[:-9], k=rng.randrange(30))) for k in range(900)]
    made = [(t, *T.smoothed(T.composed(t)), *T.smoothed(T.confusables_folded(T.composed(t)))) for t in texts]
    df = spark.createDataFrame(made, "t string, n string, n_marked boolean, f string, f_marked boolean").coalesce(1)
    got = df.select("t", "n_marked", T.finished(F.col("n"), F.col("n_marked")).alias("n"), T.normalize("t").alias("want"), T.finished(F.col("f"), F.col("f_marked")).alias("f"), T.normalize("t", fold_confusables=True).alias("want_f")).collect()
    assert [(r.n, r.f) for r in got] == [(r.want, r.want_f) for r in got] and 200 < sum(r.n_marked for r in got) < 800


def test_judged_rows_are_those_of_the_matrix(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    one = A.attack_matrix(docs).withColumn("noop", A.is_noop("text", "attacked")).withColumn("valid", A.preserves_meaning("text", "attacked"))
    changed = F.when(~F.col("noop"), F.col("attacked"))
    want = one.select("attack", "severity", "attacked", "noop", T.normalize(changed).alias("normalised"), T.normalize(changed, fold_confusables=True).alias("folded"), "valid")
    made = A.judged_matrix(docs)
    got = A.settled(made).select(want.columns)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got) == rows(want)
    assert made.where("valid is null").count() > 10 and made.where("valid").count() > 10
    with pytest.raises(ValueError):
        A.judged_matrix(docs, {"none": (0.5,)})


def test_letters_that_fold_to_listed_words_are_left(spark):
    docs = spark.createDataFrame([(1, "uſe begİn ma\u212ae Use x-use an A the")], "doc_id long, text string")
    got = {r.attack: r.attacked for r in A.attack_matrix(docs, {"synonym_swap": (1.0,), "article_deletion": (1.0,)}).collect()}
    assert got == {"synonym_swap": "uſe begİn create Employ x-use an A the", "article_deletion": "uſe begİn ma\u212ae Use x-use"}


def test_report_is_that_of_the_matrix(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one = A.attack_matrix(docs).withColumns({"s": F.length("attacked") % 101 / 101.0, "valid": A.preserves_meaning("text", "attacked")})
    want = {(r.attack, r.severity): r for r in A.attack_report(one, 0.5).collect()}
    got = {(r.attack, r.severity): r for r in catalogue.attack_report(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 17 and all(r.invalid >= 3 for r in got.values())
