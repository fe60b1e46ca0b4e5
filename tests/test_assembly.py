"""Splices, edits, decisions, gates, attributes and pools against plain Python and stated values."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.functions import attributes, spans
from textmill.operators import decisions, mixtures
from textmill.sources import pools


def _spliced(h, a, seed):
    """The interleaving slot by slot, as its definition says."""
    bits = int(hashlib.sha256(seed.encode()).hexdigest(), 16)
    plan = [bool(bits >> k & 1) for k in range(len(h) + len(a))]
    if not any(plan):
        plan[len(plan) // 2] = True
    if all(plan):
        plan[0] = False
    h, a, out = list(h), list(a), []
    for second in plan:
        side = (a or h) if second else (h or a)
        out.append((side.pop(0), "ai_generated" if side is a else "human"))
    text, found = "", []
    for k, (p, label) in enumerate(out):
        chunk = p if k == len(out) - 1 else p + "\n\n"
        if found and found[-1][2] == label:
            found[-1] = (found[-1][0], len(text) + len(chunk), label)
        else:
            found.append((len(text), len(text) + len(chunk), label))
        text += chunk
    return text, found


def test_splice(spark):
    made = lambda side, n: [f"{side}{k} é " + "word " * 20 + "end" for k in range(n)]
    cases = [(f"h{i}", f"a{i}", made("h", 2 + i % 5), made("a", 2 + i * 7 % 4)) for i in range(40)] + [("long", "x", made("h", 200), made("a", 150))]
    rows = [(h, "\n \n".join(x), a, "\n\n".join(y), "g", "train") for h, a, x, y in cases]
    rows += [("null", None, "x", "t", "g", "train"), ("one", "short", "x", rows[0][3], "g", "train")]
    df = spark.createDataFrame(rows, "human_id string, human_text string, ai_id string, ai_text string, source_group_id string, split string").withColumn("label", F.lit(1))
    got = {r["human_source_id"]: r for r in mixtures.splice(df).withColumn("tiled", spans.tiles(F.col("text"), F.col("spans"))).collect()}
    assert got.keys() == {h for h, *_ in cases}
    for h, a, x, y in cases:
        text, found = _spliced(x, y, f"{h}|{a}")
        assert got[h]["text"] == text and [tuple(s) for s in got[h]["spans"]] == found and got[h]["tiled"]
    why = {r["human_id"]: r["w"] for r in df.select("human_id", mixtures.splice_failure("human_text", "ai_text").alias("w")).collect()}
    assert why["null"] == why["one"] == "human_too_few_paragraphs" and why["h0"] is None


def test_neighbours(spark):
    docs = spark.createDataFrame([(k, f"g{k}", "train" if k < 9 else "val", f"t{k}") for k in range(10)], "doc_id long, source_group_id string, split string, text string")
    got = mixtures.neighbours(docs).collect()
    assert sorted(r["human_id"] for r in got) == sorted(r["ai_id"] for r in got) == list(range(9))
    assert all(r["human_id"] != r["ai_id"] and r["ai_text"] == f"t{r['ai_id']}" for r in got)


def test_edits(spark):
    start, end = "The first sentence stays as it was written.", "And the last one stays the same too, every word."
    rows = [
        (1, f"{start} Here something old stands in between. {end}", f"{start} Now new words fill this place instead. {end}"),
        (2, "a b c", "a b c "), (3, None, "x"), (4, "entirely other words", "nothing remains of it"), (5, "some words the rest", " new phrase the changed"),
    ]
    df = spark.createDataFrame(rows, "human_id int, human_text string, edited_text string").withColumns({"source_group_id": F.lit("g"), "split": F.lit("train"), "editor": F.lit("m")})
    told = {r["human_id"]: [tuple(s) for s in r["s"]] for r in df.select("human_id", mixtures.edit_spans("human_text", "edited_text").alias("s")).collect()}
    a, b = len(start) + 1, len(rows[0][2]) - len(end)
    assert told[1] == [(0, a, "human"), (a, b, "ai_assisted"), (b, len(rows[0][2]), "human")]
    assert told[4] == [(0, 21, "ai_assisted")] and told[5] == [(0, 23, "ai_assisted")] and told[3] == [(0, 1, "ai_assisted")]
    assert [r["human_source_id"] for r in mixtures.edited_documents(df).collect()] == [1]


def test_decisions(spark):
    df = spark.createDataFrame([(0.1,), (0.45,), (0.55,), (0.6,), (None,)], "s double")
    got = df.select("s", decisions.decide("s", decisions.Policy(0.5, 0.4, 0.6)).alias("d")).select("d.*").collect()
    assert [r["verdict"] for r in got] == ["human", "uncertain", "uncertain", "ai", None]
    assert math.isclose(got[0]["confidence"], 0.8) and got[4]["confidence"] is None
    with pytest.raises(ValueError):
        decisions.Policy(0.5, 0.6, 0.7)
    with pytest.raises(Exception, match="not a probability"):
        spark.createDataFrame([(1.5,)], "s double").select(decisions.decide("s", decisions.Policy(0.5)).alias("d")).collect()
    scores = spark.createDataFrame([(int(k > 80), k / 100) for k in range(100)], "y int, s double")
    threshold, low, high = decisions.band(scores, 0.05, 0.1)
    assert 0.76 < threshold < 0.77 + 1e-9 and (low, high) == (0.72, 0.82)
    assert decisions.band(scores, 0.05, 0.0) == (threshold,) * 3


def test_gate(spark):
    kind = "metric string, value double"
    metrics = spark.createDataFrame([("fpr", 0.02), ("fnr", math.nan), ("auroc", 0.9), ("law", 0.7), ("news", 0.8)], kind)
    rules = spark.createDataFrame(
        [("fpr", "most", 0.01), ("fnr", "most", 0.5), ("auroc", "least", 0.85), ("ece", "most", 0.1), ("law", "no_regression", None), ("news", "no_regression", None), ("auroc", "no_regression", None)],
        "metric string, rule string, bound double",
    )
    got = {(r["metric"], r["failure"]) for r in decisions.gate_failures(metrics, rules, spark.createDataFrame([("law", 0.75), ("news", 0.8)], kind)).collect()}
    assert got == {("fpr", "above_bound"), ("fnr", "metric_not_finite"), ("ece", "missing_metric"), ("law", "regression"), ("auroc", "missing_baseline")}


def test_attributes(spark):
    texts = {
        1: "- soil water\n- soil acid\n- water soil", 2: None, 3: "She said the river was wide. The river ran on.",
        4: "Pursuant considerations characterise administrative responsibilities throughout jurisdictional arrangements", 5: "You can fix it. Let's go.",
    }
    made = attributes.attributes(spark.createDataFrame(list(texts.items()), "doc_id int, text string"))
    got = {r["doc_id"]: r for r in made.collect()}
    assert (got[1]["structure"], got[1]["genre"], got[1]["topic"], got[1]["target_tokens"]) == ("listy", "list-based guide", "soil, water, acid", 9)
    assert (got[2]["topic"], got[2]["difficulty"], got[2]["key_anchors"]) == ("an unspecified subject", "moderate", ["the subject of the document"])
    assert (got[3]["genre"], got[3]["difficulty"], got[3]["topic"]) == ("narrative piece", "plain", "river, said, wide")
    assert (got[4]["genre"], got[4]["register"]) == ("formal report", "formal") and got[5]["register"] == "conversational"
    prompt = attributes.prompts(made, "[note v1]\nOn {topic} in {target_tokens} words:\n{key_anchors}").where("doc_id = 1").first()["prompt"]
    assert prompt == "On soil, water, acid in 9 words:\n- soil\n- water\n- acid"
    with pytest.raises(KeyError):
        attributes.prompts(made, "{nothing}")


def test_topics_of_documents(spark, tiny):
    """Topics, lengths and difficulty of all test documents against plain Python."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in attributes.attributes(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        words = re.findall(r"\b[a-zA-Z][a-zA-Z'-]+\b", text.lower())
        top = [w for w, _ in Counter(w for w in words if w not in attributes.NO_TOPICS and len(w) > 3).most_common(6)]
        assert got[r["doc_id"]]["key_anchors"] == (top or ["the subject of the document"])
        assert got[r["doc_id"]]["target_tokens"] == len(text.split())
        if words:
            score = len(words) / max(len(re.findall(r"[.!?]+(?:\s|$)", text)), 1) / 20 + sum(len(w) >= 8 for w in words) / len(words) / 0.15
            assert got[r["doc_id"]]["difficulty"] == ("plain" if score < 1 else "moderate" if score < 1.8 else "demanding")


def test_decoding(spark):
    df = spark.createDataFrame([("a", 10), ("b", 200), (None, 5000), ("d", None)], "doc_id string, n int")
    got = df.select("doc_id", attributes.decoding("doc_id", [0.7, 0.9], [0.9], 640, "n", greedy=True).alias("d")).select("doc_id", "d.*").collect()
    assert [r["max_new_tokens"] for r in got] == [96, 351, 640, None]
    number = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:12], 16)
    for r in got:
        if r["doc_id"] is None:
            assert r["temperature"] is None and r["seed"] is None
        else:
            assert (r["temperature"], r["top_p"]) == [(0.7, 0.9), (0.9, 0.9), (0.0, 1.0)][number(f"{r['doc_id']}|decoding") % 3]
            assert r["seed"] == number(f"{r['doc_id']}|seed") % 2**31
    with pytest.raises(Exception, match="no target of words"):
        spark.createDataFrame([(0,)], "n int").select(attributes.token_budget("n", 640).alias("b")).collect()


def test_mirrors(spark):
    source = " ".join(f"word{k}" for k in range(30))
    other = " ".join(f"term{k}" for k in range(30))
    rows = [(1, other, None), (2, source, "near_duplicate_of_source"), (3, "Sure, here it is:\n" + other, "assistant_preamble"), (4, "too few", "too_short"), (5, other + " " + other, "too_long"), (6, " ", "empty"), (7, None, "empty")]
    df = spark.createDataFrame(rows, "k int, g string, want string").withColumn("source", F.lit(source))
    assert [(r["got"], r["want"]) for r in df.select("want", attributes.mirror_rejection("g", "source", F.lit(30)).alias("got")).collect() if r["got"] != r["want"]] == []
    wrapped = spark.createDataFrame([("# Title\nBody here.\n\nLet me know if you want more!",)], "t string")
    assert wrapped.select(attributes.strip_wrapper("t").alias("t")).first()["t"] == "Body here."


def test_pools(spark, tmp_path):
    import pandas as pd

    for name, columns in (("a", ["doc_id", "source_group_id", "text"]), ("b", ["doc_id", "source_group_id", "text"])):
        at = tmp_path / f"source={name}" / "split=train"
        at.mkdir(parents=True)
        pd.DataFrame({c: ["1", "2"] for c in columns}).to_parquet(at / "p.parquet")
    plan = pools.plan_scan(spark, str(tmp_path), 0.5).collect()
    assert [r["n_rows"] for r in plan] == [2, 2]
    bad = tmp_path / "source=c" / "split=val"
    bad.mkdir(parents=True)
    pd.DataFrame({"doc_id": ["1"], "source_group_id": ["1"], "text": ["t"], "generator": ["m"]}).to_parquet(bad / "g.parquet")
    pd.DataFrame({"doc_id": ["1"]}).to_parquet(bad / "i.parquet")
    (bad / "u.parquet").write_text("no parquet")
    with pytest.raises(ValueError) as e:
        pools.plan_scan(spark, str(tmp_path), 0.5)
    assert all(w in str(e.value) for w in ("3 files", "generated", "incomplete", "unreadable"))
    with pytest.raises(ValueError):
        pools.plan_scan(spark, str(tmp_path / "none"), 0.5)


def test_reserve_and_training_rows(spark):
    docs = spark.createDataFrame([("b", "g1", "text", None), ("a", "g2", "more", "x"), ("c", "g3", " ", "x"), ("d", "g4", None, "x")], "doc_id string, source_group_id string, text string, domain string")
    assert [tuple(r) for r in pools.reserve(docs).collect()] == [("a", "g2", "more", "unknown", "x", "informational"), ("b", "g1", "text", "unknown", "unknown", "informational")]
    human = docs.withColumn("split", F.when(F.col("doc_id") == "a", "test").when(F.col("doc_id") != "d", "train"))
    mixed = spark.createDataFrame([("m", "g5", "train", "abcd", [(0, 2, "human"), (2, 4, "ai_generated")])], "doc_id string, source_group_id string, split string, text string, spans array<struct<start_char:bigint,end_char:bigint,label:string>>")
    got = {r["doc_id"]: (r["label"], r["domain"]) for r in pools.training_rows(human, mixed=mixed, splits=("train",)).collect()}
    assert got == {"b": (0, "unknown"), "c": (0, "x"), "m": (1, "unknown")}
    assert pools.training_rows(human, mixed=mixed, limit=2).count() == 2
    roster = spark.createDataFrame([("x", "held_in"), ("y", "held_out")], "family string, role string")
    pools.require_no_held_out(roster, roster.where("family = 'x'"))
    with pytest.raises(ValueError):
        pools.require_no_held_out(roster, roster)
