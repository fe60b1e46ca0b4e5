"""Published versions, negative controls and quotes of parsed documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import controls, lake
from textmill.operators.publish import BrokenWrite, Corpus, segments_fingerprint
from textmill.sources import readers

DOCS = "doc_id string, content_sha256 string, source string, split string, text string"


def docs(spark, n, seed=0):
    rows = [(f"d{i}", f"{(i * 7919 + seed) % 10**6:064x}", f"s{i % 3}", ("train", "val", "test")[i % 3], f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_versions_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, str(tmp_path / "c"))
    assert corpus.manifest() is None
    with pytest.raises(ValueError):
        corpus.read()
    segments = spark.createDataFrame([("/a/x.gz", False), ("crawl/y.gz", False)], "path string, failed boolean")
    one = corpus.publish(docs(spark, 90), segments=segments, counts={"kept": 95, "duplicates": 3, "overlaps": 2})
    assert one["rows"] == 90 and one["by_split"] == {"train": 30, "val": 30, "test": 30} and one["sources"] == {"s0": 30, "s1": 30, "s2": 30}
    assert corpus.read().count() == 90 and set(corpus.read().columns) == set(DOCS.replace(" string", "").split(", "))
    # order and partitioning do not change the fingerprint, a row does
    two = corpus.publish(docs(spark, 90).repartition(5).orderBy(F.rand(1)))
    three = corpus.publish(docs(spark, 91))
    assert two["fingerprint"] == one["fingerprint"] != three["fingerprint"] and corpus.versions() == [1, 2, 3]
    assert corpus.read(1).count() == 90 and corpus.read().count() == 91

    # a task that dies, a file that is lost after the write, a failed segment, counts that do not add up: nothing is seen
    with pytest.raises(Exception, match="gone"):
        corpus.publish(docs(spark, 9).withColumn("text", F.when(F.col("doc_id") == "d5", F.raise_error(F.lit("gone"))).otherwise(F.col("text"))))
    real = lake.write_rows

    def lossy(rows, root, *, mode):
        import glob
        import os

        real(rows, root, mode=mode)
        os.remove(sorted(glob.glob(f"{root}/source=s1/*/part-*"))[0])

    monkeypatch.setattr(lake, "write_rows", lossy)
    with pytest.raises(BrokenWrite):
        corpus.publish(docs(spark, 50))
    monkeypatch.setattr(lake, "write_rows", real)
    with pytest.raises(BrokenWrite):
        corpus.publish(docs(spark, 9), segments=segments.withColumn("failed", F.col("path") == "crawl/y.gz"))
    with pytest.raises(ValueError):
        corpus.publish(docs(spark, 9), counts={"kept": 95, "duplicates": 3, "overlaps": 2})
    assert corpus.versions() == [1, 2, 3] and corpus.read().count() == 91
    assert len(corpus.sweep()) == 3 and corpus.sweep() == [] and corpus.read(2).count() == 90
    assert corpus.publish(docs(spark, 5).limit(0))["rows"] == 0 and corpus.read().count() == 0


def test_segments_fingerprint(spark):
    told = [segments_fingerprint(spark.createDataFrame([(p,) for p in ps], "path string")) for ps in (["/a/x", "c/y"], ["c/y", "/b/q/x"], ["x", "y"], ["/a/x"])]
    assert told[0] == told[1] and len(set(told)) == 3


def test_negative_control(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.random()) for i in range(2000)], "doc_id long, feature double")
    honest = lambda marked: marked.select("y", F.col("feature").alias("s"))
    for found in controls.negative_control(rows, honest, repeats=3):
        assert found.passed and found.n == 2000 and found.margin == pytest.approx(4 / (2 * 2000**0.5))
        found.require()
    # a learner that has seen the ids, or whose features hold the label for a tenth of the rows more than chance
    leaking = lambda marked: marked.select("y", (F.col("y") * 0.3 + F.col("feature")).alias("s"))
    found = controls.negative_control(rows, leaking)[0]
    assert not found.passed
    with pytest.raises(ValueError, match="reads the pipeline"):
        found.require()
    assert controls.labelled(rows, "doc_id").exceptAll(controls.labelled(rows.repartition(7), "doc_id")).isEmpty()
    for bad in (lambda m: m.select("y", F.lit(float("nan")).alias("s")), lambda m: m.where("y = 1").select("y", F.lit(0.5).alias("s"))):
        with pytest.raises(ValueError):
            controls.negative_control(rows, bad)
    with pytest.raises(ValueError):
        controls.negative_control(rows.limit(1), honest)
    with pytest.raises(ValueError):
        controls.chance_margin(0)


def test_quotes_of_parsed_documents(spark):
    a, b, c = "This is a sentence that is long enough.", "Another sentence that is quite long too!", "short."
    rows = [
        (1, json.dumps({"chunks": [{"text": f"{a} {c}", "blocks": [{"page": None}, {"page": 3}, {"page": 4}]}, {"text": f"{a.upper()} {b}", "blocks": []}, {"blocks": [{"page": 9}]}, {"text": None}]})),
        (2, "no json"), (3, None), (4, json.dumps({"pages": []})),
        (5, json.dumps({"chunks": [{"text": " ".join(f"Sentence number {k} of a very long text." for k in range(20)), "blocks": [{"page": 1}]}]})),
    ]
    got = {}
    for r in readers.parsed_quotes(spark.createDataFrame(rows, "doc_id long, parsed string")).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.quote, r.page))
    assert got[1] == [(0, a, 3), (1, b, None)] and set(got) == {1, 5}
    assert got[5] == [(k, f"Sentence number {k} of a very long text.", 1) for k in range(8)]
