"""Every operator and stage on awkward and on empty tables."""

import pytest

import corpus_pipeline
from tests.llm.common import awkward, empty
from textmill.llm import decontamination, hmm, language, licences, packing, quality, rollups, sharding, similar, simhash, substrings


def _tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, None, None), (7, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")


def _items(spark):
    return spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(20, 45))), (2, None), (None, ""), (3, "beta gamma.")], "item_id long, text string")


OPERATORS = {
    "sharding": lambda s, d: sharding.shard_documents(d),
    "packing": lambda s, d: packing.pack(d, _tokenizer()),
    "decontamination": lambda s, d: decontamination.leaks(d, _items(s)),
    "hmm": lambda s, d: hmm.score_documents(d, language.held_out(7, 2)),
    "substrings": lambda s, d: substrings.removal_digest(d, substrings.repeated_spans(d)),
    "licences": lambda s, d: licences.scan(d),
    "language": lambda s, d: language.predict_languages(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "similar": lambda s, d: similar.similar_groups(d),
    "quality": lambda s, d: quality.judge(d, _labels(s)),
}
#: Operators that return one row for each document.
WHOLE = {"sharding", "hmm", "substrings", "language", "simhash", "similar", "quality"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward(spark, name):
    docs = awkward(spark)
    rows = OPERATORS[name](spark, docs).collect()
    if name in WHOLE:
        key = lambda i: (i is not None, i or 0)
        assert sorted((r.doc_id for r in rows), key=key) == sorted((r.doc_id for r in docs.collect()), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


def test_rollup_awkward(spark, tmp_path):
    docs = awkward(spark)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollups.document_totals(docs, _labels(spark), str(tmp_path / "a"), _tokenizer()).collect()}
    # without rows that have no id, with the repeated row once, and with document 4 gone
    assert {k: v for k, v in got.items() if k[2] == "words"} == {
        ("a", "en", "words"): (2, 120), (None, None, "words"): (1, 0), ("a", None, "words"): (1, 0), ("b", "en", "words"): (1, 60_000),
        ("b", "de", "words"): (1, 62), ("b", "fr", "words"): (1, 6), ("c", "en", "words"): (1, 8),
    }
    assert rollups.document_totals(empty(spark), _labels(spark), str(tmp_path / "b"), _tokenizer()).collect() == []


def test_rollup_batches_are_idempotent_and_ordered(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    add = lambda rows: spark.createDataFrame(rows, rollups.CHANGES)
    assert r.commit(1, add([("insert", 1, "s", "en", "v1", 10), ("insert", 2, "s", "en", "v1", 5)]))
    assert not r.commit(1, add([("insert", 3, "s", "en", "v1", 99)]))
    with pytest.raises(ValueError):
        r.commit(3, add([]))
    assert r.commit(2, add([("revise", 1, None, None, "v1", 7), ("delete", 2, None, None, "v1", None)]))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v1", 1, 7)]
    assert [tuple(x) for x in r.totals(1).collect()] == [("s", "en", "v1", 2, 15)]


def test_rollup_of_changes_that_meet(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"), compact=2)
    add = lambda rows: spark.createDataFrame(rows, rollups.CHANGES)
    r.commit(1, add([("insert", 1, "s", "en", "v", 10), ("insert", 1, "s", "en", "v", 10), ("insert", 2, "s", "en", "v", 4), ("revise", 2, None, None, "v", 5), ("insert", 3, "s", "en", "v", 7), ("delete", 3, None, None, "v", None)]))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 2, 15)]
    # an insert of what is held puts it in its place; what is not held is neither revised nor deleted
    r.commit(2, add([("insert", 1, "t", None, "v", 3), ("revise", 9, None, None, "v", 5), ("delete", 8, None, None, "v", None), (None, 1, "s", "en", "v", 1), ("insert", None, "s", "en", "v", 1)]))
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "v", 1, 5), ("t", None, "v", 1, 3)}
    r.vacuum()
    r.commit(3, add([("delete", 2, None, None, "v", None), ("delete", 2, None, None, "v", None)]))
    r.commit(4, add([]))
    r.commit(5, add([("revise", 1, None, None, "v", None)]))
    assert {tuple(x) for x in r.totals().collect()} == {("t", None, "v", 1, 0)}
    assert r._written("snapshot") == [2, 4] and r._written("log") == [3, 4, 5] and r.committed() == 5


def test_a_small_batch_reads_the_slots_of_its_documents(spark, tmp_path):
    r = rollups.Rollup(spark, str(tmp_path / "r"), compact=2)
    add = lambda rows: spark.createDataFrame(rows, rollups.CHANGES)
    for k in range(3):
        assert r.commit(k + 1, add([("insert", i, "s", "en", "v", i + k) for i in range(100 * k, 100 * k + 300)]))
    spark.createDataFrame([(150, "v")], "doc_id long, tokenizer string").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    slot = keys.select(rollups._slot()).first().slot
    held = r.held(3, keys, [slot])
    assert [tuple(x) for x in held.select("doc_id", "docs", "tokens").collect()] == [(150, 1, 151)]
    plan = held._jdf.queryExecution().executedPlan().toString()
    pruned = [line for line in plan.splitlines() if "Scan parquet" in line and "slot#" in line]
    assert len(pruned) == 2 and all("PartitionFilters: [isnotnull(slot" in line and f" = {slot})" in line for line in pruned)
    # rows of other keys go before anything is grouped, and what is held is not moved for that
    assert plan.index("BroadcastHashJoin") > plan.index("HashAggregate") and plan.count("Exchange hashpartitioning") == 1
    assert r.commit(4, add([("delete", 150, None, None, "v", None)])) and r.totals().first().n_docs == 499


def test_stages(spark, tmp_path):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    _items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(tmp_path))
            assert kept.columns == docs.columns, name
            kept.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_stage_decisions(spark, tmp_path):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    _items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w57 ", "other ")
    leak = " ".join(f"z{i}" for i in range(40)) + " " + " ".join(f"alpha{i}" for i in range(20, 45))
    docs = spark.createDataFrame([(1, base), (2, base), (3, near), (4, leak), (5, "short text")], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    at = str(tmp_path)
    assert {r.doc_id for r in stages["quality_rules"](spark, docs, at).collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, at).collect()} == {1, 4, 5}
    cut = {r.doc_id: r.text for r in stages["substring_dedup"](spark, docs, at).collect()}
    assert cut[1] == base and cut[2] == "" and cut[3] == "other"
    assert {r.doc_id for r in stages["decontamination"](spark, docs, at).collect()} == {1, 2, 3, 5}


def test_similar_groups_match_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [f"v{rng.randrange(900)}" for _ in range(220)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"q{rng.randrange(5000)}" for _ in range(150)) for _ in range(20)]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_similar_finds_copies_cut_short_or_appended_to(spark):
    import random

    rng = random.Random(5)
    pairs = []
    for k in range(120):
        n = (60, 200, 700, 2500)[k % 4]
        base = [f"v{rng.randrange(3000)}" for _ in range(n)]
        other = base[: int(0.83 * n)] if k % 3 else base + [f"x{rng.randrange(3000)}" for _ in range(int(0.22 * n))]
        pairs.append((" ".join(base), " ".join(other)))
    near = set()
    for k, pair in enumerate(pairs):
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in pair)
        if len(a & b) >= 0.8 * len(a | b):
            near.add(k)
    docs = spark.createDataFrame([(2 * k + i, t) for k, pair in enumerate(pairs) for i, t in enumerate(pair)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert len(near) > 100
    assert got == {d: d - d % 2 if d // 2 in near else d for d in got}
