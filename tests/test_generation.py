"""Rounds of generation with a fake model whose calls are written down."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from textmill.functions.attributes import MirrorPolicy
from textmill.operators import generation as G

FAMILIES = ["alpha", "beta"]
TEMPLATE = "Write about {topic}.\n{key_anchors}\nGenre {genre}, {register}, {target_tokens} words."


def model(log, fail_after=None):
    """A generator that notes each prompt in a file, answers well on even seeds, and else too short; it may break down."""

    def make(family):
        def answer(prompts, decodings):
            out = []
            for p, d in zip(prompts, decodings, strict=True):
                with open(f"{log}/{family}", "a") as f:
                    f.write(f"{len(p)}|{d['seed']}\n")
                if fail_after is not None and sum(1 for n in glob.glob(f"{log}/*") for _ in open(n)) > fail_after:
                    raise RuntimeError("the machine is gone")
                n = int(p.split(" words")[0].rsplit(" ", 1)[-1]) if " words" in p else 20
                out.append(" ".join(f"g{d['seed'] % 997}x{i}" for i in range(n if d["seed"] % 2 == 0 else 1)))
            return out

        return answer

    return make


@pytest.fixture
def humans(spark):
    rows = [(i, f"grp_{i}", " ".join(f"thing{chr(97 + i % 26)}{chr(97 + j % 26)}{'x' * (i // 26)}" for j in range(40)) + ".", "web", "train" if i % 4 else "val") for i in range(40)]
    return spark.createDataFrame([*rows, (None, "g", "x y z", "web", "train"), (99, "g", None, "web", "train")], "doc_id long, source_group_id string, text string, domain string, split string")


def calls(log):
    return {os.path.basename(n): len(open(n).readlines()) for n in glob.glob(f"{log}/*")}


def test_rounds_add_up_and_inherit(spark, humans, tmp_path):
    (tmp_path / "log").mkdir()
    requests, refused = G.mirror_requests(humans, TEMPLATE, FAMILIES)
    rounds = G.Rounds(spark, str(tmp_path / "r"), retries=2, parts=2, batch=7)
    rounds.run(requests, model(tmp_path / "log"))
    by = {r.family: r for r in rounds.summary().collect()}
    assert sum(r.requests for r in by.values()) == 40 and refused.collect() == []
    assert calls(tmp_path / "log") == {f: r.attempts for f, r in by.items()}
    counts = {(r.family, r.attempt, r.reason): r.n for r in rounds.counts().collect()}
    for f, r in by.items():
        assert sum(n for (g, _, why), n in counts.items() if g == f and why is None) == r.accepted
        # a seed is even at the second attempt at the latest
        assert r.accepted == r.requests and r.given_up == 0 and r.acceptance == pytest.approx(r.accepted / r.attempts)
        assert {why for (g, _, why) in counts if g == f} == {None, "too_short"} and max(k for g, k, _ in counts if g == f) == 1
    mirrors = rounds.accepted()
    G.require_mirrors(humans, mirrors)
    with pytest.raises(ValueError):
        G.require_mirrors(humans, mirrors.withColumn("split", F.lit("test")))
    G.require_held_in(mirrors, [G.Family("alpha", "held_in"), G.Family("beta", "held_in")])
    with pytest.raises(ValueError):
        G.require_held_in(mirrors, [G.Family("alpha", "held_in"), G.Family("beta", "held_out")])


def test_killed_round_resumes_without_asking_twice(spark, humans, tmp_path):
    (tmp_path / "log").mkdir()
    requests, _ = G.mirror_requests(humans, TEMPLATE, ["alpha"])
    rounds = G.Rounds(spark, str(tmp_path / "r"), parts=4)
    with pytest.raises(Exception, match="the machine is gone"):
        rounds.run(requests, model(tmp_path / "log", fail_after=25))
    kept = {r.key: (r.text, r.seed) for r in rounds.ledger().collect()}
    assert 0 < len(kept) < 40
    (tmp_path / "again").mkdir()
    rounds.run(requests.limit(0), model(tmp_path / "again"))
    first = {r.key: (r.text, r.seed) for r in rounds.ledger(0).collect()}
    assert len(first) == 40 and kept.items() <= first.items()
    n = rounds.ledger().count()
    assert calls(tmp_path / "again")["alpha"] == n - len(kept)
    (tmp_path / "third").mkdir()
    rounds.run(requests, model(tmp_path / "third"))
    assert calls(tmp_path / "third") == {} and rounds.ledger().count() == n


def test_families_one_by_one_are_those_of_a_whole_run(spark, humans, tmp_path):
    (tmp_path / "log").mkdir()
    requests, _ = G.mirror_requests(humans, TEMPLATE, FAMILIES)
    whole, split = (G.Rounds(spark, str(tmp_path / n), parts=1) for n in ("w", "s"))
    whole.run(requests, model(tmp_path / "log"))
    for family in FAMILIES:
        split.run(requests, model(tmp_path / "log"), only=family)
    told = lambda r: sorted((x.key, x.family, x.text) for x in r.accepted().collect())
    assert told(whole) == told(split)
    with pytest.raises(ValueError):
        split.run(requests, model(tmp_path / "log"), only="gamma")


def test_random_arm(spark, humans, tmp_path):
    (tmp_path / "log").mkdir()
    pool = spark.createDataFrame([(20,), (30,), (None,), (40,)], "token_count int")
    make = lambda p: G.random_requests(p, 30, ["bread", "rivers"], ["letter"], ["plain", "formal"], FAMILIES)
    requests = make(pool)
    rows = {r.key: r for r in requests.collect()}
    assert len(rows) == 30 and {r.target_tokens for r in rows.values()} == {20, 30, 40}
    assert {k: (r.prompt, r.family) for k, r in rows.items()} == {r.key: (r.prompt, r.family) for r in make(pool.repartition(3)).collect()}
    one = rows["rand_3"]
    assert one.prompt.startswith("Write a letter in a ") and f"approximately {one.target_tokens} words" in one.prompt and one.source_group_id == "grp_rand_3"
    rounds = G.Rounds(spark, str(tmp_path / "r"), parts=1)
    rounds.run(requests, model(tmp_path / "log"), reason=G.refusal(MirrorPolicy(longest=2.0)))
    assert rounds.accepted().count() == 30
    with pytest.raises(ValueError):
        make(pool.limit(0))
    assert G.length_pool(humans).count() == 41


def test_anchors_that_copy(spark):
    source = "One two three four five six seven eight nine ten."
    rows = [(["soil chemistry"], False), (["one two three four"], False), (["one two three four five"], True), (["One two three four five six seven eight"], True), ([], False)]
    df = spark.createDataFrame([(a, source) for a, _ in rows], "a array<string>, t string")
    assert [r.c for r in df.select(G.copies_source("a", "t").alias("c")).collect()] == [w for _, w in rows]


def test_no_requests(spark, humans, tmp_path):
    requests, _ = G.mirror_requests(humans.limit(0), TEMPLATE, FAMILIES)
    rounds = G.Rounds(spark, str(tmp_path / "r"))
    rounds.run(requests, model(tmp_path))
    assert rounds.accepted().isEmpty() and rounds.summary().isEmpty()
