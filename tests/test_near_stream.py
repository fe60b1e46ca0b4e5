"""Near-duplicates in a stream against the batch operator."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import dedup
from textmill.streaming.near import NearDuplicateStream

SCHEMA = "doc_id long, acquired_at timestamp, text string"


@pytest.fixture(scope="module")
def rows():
    import datetime

    rng, out, bases = random.Random(8), [], []
    start = datetime.datetime(2026, 1, 1)
    for i in range(90):
        if i % 3 or not bases:
            words = [f"w{rng.randrange(4000)}" for _ in range(120)]
            bases.append(words)
        else:
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 3, 30])):
                words[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        out.append((i, start + datetime.timedelta(minutes=i), " ".join(words)))
    return out


def test_stream_equals_batch(spark, rows, tmp_path):
    whole = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id for r in dedup.near_duplicates(whole).collect()}
    assert len(want) > 10
    for k in range(3):
        whole.where(F.col("doc_id").between(30 * k, 30 * k + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = NearDuplicateStream(spark, str(tmp_path / "state"), horizon=1e9)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.start(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    told = {r.id: r.duplicate_of for r in state.decisions().collect()}
    assert len(state.committed()) == 3 and len(told) == 90
    assert {i for i, of in told.items() if of is not None} == want
    assert all(of is None or told[of] is None and of < i for i, of in told.items())


def test_batches_again_broken_off_and_forgotten(spark, rows, tmp_path):
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    state = NearDuplicateStream(spark, str(tmp_path / "s"), horizon=3600)
    base, late = rows[0], rows[80]
    assert state.judge(frame([base, (500, base[1], base[2]), (501, None, None), (None, base[1], "x")]), 0)
    assert not state.judge(frame(rows), 0)
    assert {r.id: r.duplicate_of for r in state.decisions().collect()} == {0: None, 500: 0, 501: None}
    # what a batch left that was never committed is not read
    frame([late]).select(F.col("doc_id").alias("id")).write.parquet(str(tmp_path / "s" / "decisions" / "1"))
    assert state.decisions().count() == 3
    assert state.judge(frame([(600, rows[1][1], base[2]), late]), 1)
    assert {r.id: r.duplicate_of for r in state.decisions().where("id in (600, 80)").collect()} == {600: 0, 80: None}
    # an hour and more after the first, it is forgotten
    assert state.judge(frame([(700, late[1], base[2]), (701, late[1], late[2])]), 2)
    assert {r.id: r.duplicate_of for r in state.decisions().where("id >= 700").collect()} == {700: None, 701: 80}
    assert state.vacuum() == [0] and state.decisions().count() == 7
    assert state.judge(frame([]), 3) and state.judge(frame([(800, late[1], base[2])]), 4)
    assert {r.duplicate_of for r in state.decisions().where("id = 800").collect()} == {700}
