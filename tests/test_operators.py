"""Operators against plain Python, on small hand-made rows."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import attacks, spans
from textmill.functions import text as T
from textmill.operators import audits, dedup, lake, metrics, mining, sampling
from textmill.sources import readers
from textmill.streaming import feedback


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<b>a</b>   b\n\n\n\nc ", "a b\n\nc"),
        ("x<script>y</script>[l](u) &amp;&#12;", "x l &"),
        ("a​b ­c", "ab c"),
        ("ﬁne　word", "fine word"),
        ("", ""),
    ],
)
def test_normalize(spark, text, want):
    assert _one(spark, text, T.normalize) == want


def test_fold(spark):
    assert _one(spark, "раypаl", T.fold_confusable_letters) == "paypal"
    assert _one(spark, "Неllо", attacks.fold_homoglyphs) == "Hello"


def test_redact(spark):
    text = "mail a.b@c.org, call 555-123-4567, card 4111 1111 1111 1111, not 1234 5678 9012 3456, host 10.0.0.1, ssn 123-45-6789"
    got = _one(spark, text, T.redact)
    assert got["text"] == "mail [EMAIL], call [PHONE], card [CREDIT_CARD], not 1234 5678 9012 3456, host [IP], ssn [SSN]"
    assert got["flags"] == ["CREDIT_CARD", "EMAIL", "IP", "PHONE", "SSN"]


def test_minhash_matches_big_integers():
    a, b = dedup.coefficients(16)
    x = dedup.shingle_hashes("one two three four five six seven eight", 5)
    want = [min(((int(p) * int(v) + int(q)) % dedup.PRIME) & dedup.LOW32 for v in x) for p, q in zip(a, b, strict=True)]
    assert dedup.minhash(x, a, b).tolist() == want


def test_greedy_near_duplicates(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(180)]
    rows = [("a", " ".join(base)), ("b", " ".join([*base, "one", "more"])), ("c", " ".join(base)), ("d", " ".join(f"z{i}" for i in range(100)))]
    got = {r.doc_id: r.duplicate_of for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"b": "a", "c": "a"}


def test_within_distance(spark):
    rows = [(1, 0), (2, 0b111), (3, -1), (4, 0), (5, (1 << 40) | (1 << 50))]
    got = {(r.a, r.b, r.distance) for r in dedup.within_distance(spark.createDataFrame(rows, "id long, h long"), "id", "h").collect()}
    assert got == {(1, 2, 3), (1, 5, 2), (1, 4, 0), (2, 5, 5)}


def test_metrics_match_definitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), round(rng.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.auroc(df).first()["auroc"] == pytest.approx(want)
    cut = metrics.threshold_at_fpr(df, 0.1).first()["cut"]
    assert sum(n > cut for n in neg) / len(neg) <= 0.1 < sum(n >= cut for n in neg) / len(neg) + 1e-9


def test_temperature(spark):
    rows = [([0.0, 2.0], 1)] * 8 + [([0.0, 2.0], 0)] * 2
    best, at_bound = metrics.fit_temperature(spark.createDataFrame(rows, "logits array<double>, y int"))
    assert best == pytest.approx(2 / 1.386294, rel=0.02) and not at_bound


def test_mcnemar():
    assert metrics.mcnemar(0, 0)["exact_p"] == 1.0
    assert metrics.mcnemar(10, 2)["exact_p"] == pytest.approx(0.03857, abs=1e-4)


def test_quotas():
    assert sampling.cap_quotas({"a": 8, "b": 1, "c": 1}, 5) == {"a": 4, "b": 0, "c": 1}
    assert sum(sampling.largest_remainder({"a": 5, "b": 5, "c": 1}, 7).values()) == 7
    assert sampling.proportional_quotas({1: 120, 2: 40, 3: 20}, 60, 10) == {1: 30, 2: 17, 3: 13}
    assert sum(sampling.proportional_quotas({1: 120, 2: 40, 3: 20}, 20, 10).values()) == 20
    assert sampling.matching_quotas({"x": 2, "y": 9}, {"x": 5, "y": 5}, 8) == {"x": 2, "y": 6}


def test_exact_counts_of_caps(spark):
    rows = [(i, "train" if i % 4 else "val", "w " * (50 + i * 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, split string, text string")
    assert sampling.cap_documents(df, 50).count() == 50
    assert sampling.cap_documents_matching(df, df.where("doc_id < 40"), 33).count() == 33
    small, large = ({r.doc_id for r in sampling.subsample(df, n).collect()} for n in (10, 30))
    assert small < large


def test_spans(spark):
    df = spark.createDataFrame([("hello world", [(0, 6, "human"), (6, 8, "ai_generated"), (8, 11, "ai_generated")])], "text string, s array<struct<start_char:long,end_char:long,label:string>>")
    offsets = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((0, 5), (5, 9), (9, 11), (11, 11))])
    r = df.select(
        spans.tiles(F.col("text"), F.col("s")).alias("ok"), spans.merge_adjacent(F.col("s")).alias("m"), spans.ai_char_fraction(F.col("text"), F.col("s")).alias("f"), spans.align(offsets, F.col("s")).alias("a")
    ).first()
    assert r.ok and [tuple(x) for x in r.m] == [(0, 6, "human"), (6, 11, "ai_generated")]
    assert r.f == pytest.approx(5 / 11) and r.a == [0, 2, 2, -100]


def test_segment_counts(spark):
    df = spark.createDataFrame([(1, [0, 2, 2, 0, -100, 2], [0, 2, 2, 2, 0, 0])], "doc_id long, y_true array<int>, y_pred array<int>")
    r = spans.segment_counts(df).first()
    assert (r.segments_matched, r.segments_true, r.segments_pred) == (1, 2, 1)
    assert (r.boundaries_matched, r.boundaries_true, r.boundaries_pred) == (2, 3, 2)


def test_attacks(spark):
    text = "The big cat. It can help a lot. However we use it."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a big-time e-big user's big"), (5, text * 40)], "doc_id long, text string")
    always = {a: (1.0,) for a in attacks.SEVERITIES}
    got = {(r.doc_id, r.attack): r.attacked for r in attacks.attack_matrix(docs, always).collect()}
    assert len(got) == 5 * len(always)
    assert got[1, "synonym_swap"] == "The large cat. It can assist a lot. Nevertheless we employ it."
    assert got[1, "article_deletion"] == "big cat. It can help lot. However we use it."
    assert got[1, "case_perturb"] == text.swapcase()
    assert got[1, "whitespace_perturb"] == text.replace(" ", "  ")
    assert got[1, "zero_width_insert"] == "".join(c + "\u200b" for c in text)
    assert got[1, "paragraph_insert"].count("\n\n") == 3
    assert sorted(got[1, "sentence_reorder"].split(". ")) != [] and got[1, "sentence_reorder"] != ""
    assert got[4, "synonym_swap"] == "a big-time e-big user's large"
    assert {got[2, a] for a in always} == {None} and {got[3, a] for a in always} == {""}
    half = [(r.doc_id, r.attack, r.severity, r.attacked) for r in attacks.attack_matrix(docs).collect()]
    assert sorted(half, key=str) == sorted(((r.doc_id, r.attack, r.severity, r.attacked) for r in attacks.attack_matrix(docs.repartition(3)).collect()), key=str)
    drawn = next(t for d, a, s, t in half if (d, a, s) == (5, "zero_width_insert", 0.05))
    assert 0.02 < drawn.count("\u200b") / len(text * 40) < 0.08
    with pytest.raises(ValueError):
        attacks.attack_matrix(docs, {"none": (0.5,)})


def test_preserves_meaning(spark):
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(words, words), (words, words.replace("o", "о")), (words, words.upper()[::-1]), ("", ""), (words, None), (words, words + " end")]
    df = spark.createDataFrame(rows, "a string, b string").select(attacks.preserves_meaning("a", "b").alias("ok"))
    assert [r.ok for r in df.collect()] == [True, True, False, False, False, True]


def test_wet(spark, tmp_path):
    def record(kind, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{body[:2]}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    (tmp_path / "a.wet.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in (("warcinfo", "info"), ("conversion", "some text"), ("conversion", "   "))))
    (tmp_path / "b.wet").write_bytes(record("conversion", "whole")[:-8])
    rows = readers.wet(spark, str(tmp_path)).collect()
    assert [(r.source_record_id, r.text) for r in rows if r.error is None] == [("urn:so", "some text")]
    assert sum(r.error is not None for r in rows) == 1


def test_benchmarks(spark):
    hc3 = spark.createDataFrame([(1, "q", ["a", " "], ["b"], "s")], "id long, question string, human_answers array<string>, chatgpt_answers array<string>, source string")
    assert {(r.doc_id, r.label) for r in readers.parse_hc3(hc3).collect()} == {("hc3_q1_human_0", 0), ("hc3_q1_chatgpt_0", 1)}
    with pytest.raises(ValueError):
        readers.parse_raid(hc3)


def test_audits(spark):
    rows = spark.createDataFrame([("g1", "train"), ("g1", "test"), ("g2", "val")], "source_group_id string, split string")
    assert [r[0] for r in audits.leaking_groups(rows).collect()] == ["g1"]
    with pytest.raises(ValueError):
        audits.require_no_leakage(rows)


def test_fingerprint_is_order_free(spark):
    rows = [("a", "1"), ("b", "2"), ("c", "3")]
    one, two = (lake.fingerprint(spark.createDataFrame(r, "doc_id string, content_sha256 string")).first() for r in (rows, rows[::-1]))
    assert one == two
    with pytest.raises(ValueError):
        lake.reconciled(5, 3, 1, 0)


def test_mining_and_clusters(spark):
    docs = spark.createDataFrame([(i, f"text {'x' * (i % 3) * 30} {i}", "d", "s", "r") for i in range(30)], "doc_id long, text string, domain string, source string, register string")
    pool = mining.scored(docs, lambda: lambda texts: [0.97 if "xxx" in t else 0.02 for t in texts])
    found = mining.false_positives(pool, 0.5)
    assert found.count() == 20 and mining.false_negatives(pool, 0.5).count() == 10
    clusters = mining.kmeans(mining.embed(found), 2).labels
    assert clusters.count() == 20
    assert mining.cluster_summary(found.join(clusters, "sample_id")).agg(F.sum("size")).first()[0] == 20


MOVES = [("i1", 1, "submitted", None), ("i1", 2, "triaged", None), ("i1", 3, "verified", None), ("i1", 4, "verified", "human"), ("i2", 1, "triaged", None)]


def test_feedback_replay(spark):
    steps = feedback.replay(spark.createDataFrame(MOVES, "item_id string, seq int, state string, label string"))
    assert [r.moved for r in steps.where("item_id = 'i1'").collect()] == [True, True, False, True]
    assert [tuple(r) for r in feedback.verified(steps).collect()] == [("i1", "human")]


def test_feedback_stream(spark, tmp_path):
    schema = "item_id string, seq int, state string, label string"
    for k, part in enumerate((MOVES[:2], MOVES[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = feedback.transitions(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("moves").count() == 5
