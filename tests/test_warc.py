"""Crawl segments by splits, whole, short, corrupt and missing."""

import gzip
import random

import pytest

from textmill.sources import warc


def record(kind, body, i, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{i}>", f"WARC-Target-URI: https://example.org/{i}", "WARC-Date: 2026-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def segment(n, seed):
    rng = random.Random(seed)
    records = [record("warcinfo", b"info", "i")]
    for i in range(n):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 40, 400]))) if i % 9 else "  "
        records.append(record("conversion", text.encode(), f"{seed}-{i}"))
    return records


@pytest.fixture(scope="module")
def segments(tmp_path_factory):
    at = tmp_path_factory.mktemp("crawl")
    whole = [b"".join(gzip.compress(r) for r in segment(120, k)) for k in (1, 2)]
    (at / "a.warc.wet.gz").write_bytes(whole[0])
    (at / "b.warc.wet.gz").write_bytes(whole[1])
    (at / "short.warc.wet.gz").write_bytes(whole[0][: len(whole[0]) * 2 // 3])
    broken = bytearray(whole[1])
    broken[len(broken) // 2 : len(broken) // 2 + 40] = b"\x00" * 40
    (at / "broken.warc.wet.gz").write_bytes(bytes(broken))
    (at / "empty.warc.wet.gz").write_bytes(b"")
    (at / "junk.warc.wet.gz").write_bytes(b"<html>503</html>" * 50)
    (at / "plain.warc.wet").write_bytes(b"".join(segment(20, 3)))
    return at


@pytest.mark.parametrize("split", [1 << 26, 5000, 700])
def test_records_and_one_row_a_segment(spark, segments, split):
    names = ["a.warc.wet.gz", "b.warc.wet.gz", "short.warc.wet.gz", "broken.warc.wet.gz", "empty.warc.wet.gz", "junk.warc.wet.gz", "plain.warc.wet", "missing.warc.wet.gz"]
    records, told = warc.crawl(spark, [f"{segments}/{n}" for n in names], split_bytes=split, retries=0)
    by = {r.path.rsplit("/", 1)[1].split(".")[0]: r for r in told.collect()}
    assert len(by) == 8
    assert {n for n, r in by.items() if r.failed} == {"short", "broken", "junk", "missing"}
    assert "inside" in by["short"].error and "not there" in by["missing"].error
    assert by["a"].bytes == by["a"].size and by["a"].members == 121 and by["empty"].members == 0
    got = {}
    for r in records.collect():
        got.setdefault(r.path.rsplit("/", 1)[1].split(".")[0], []).append((r.source_record_id, r.text))
    assert set(got) == {"a", "b", "plain"}
    for name, n, seed in (("a", 120, 1), ("b", 120, 2), ("plain", 20, 3)):
        want = []
        for i, raw in enumerate(segment(n, seed)[1:]):
            text = raw.partition(b"\r\n\r\n")[2][:-4].decode()
            if text.strip():
                want.append((f"urn:uuid:{seed}-{i}", text))
        assert sorted(got[name]) == sorted(want) and by[name].records == len(want)


def test_declared_lengths(spark, segments):
    path = f"{segments}/a.warc.wet.gz"
    declared = spark.createDataFrame([(path, 10**9)], "path string, bytes long")
    records, told = warc.crawl(spark, [path], declared=declared)
    assert told.first().failed and "of 1000000000 bytes" in told.first().error and records.isEmpty()


def test_patterns_and_folders(spark, segments):
    assert [p.rsplit("/", 1)[1] for p, _ in warc.listed(f"{segments}/[ab].warc*")] == ["a.warc.wet.gz", "b.warc.wet.gz"]
    assert len(warc.listed(str(segments))) == 7 and warc.listed(f"{segments}/none*") == []
    records, told = warc.crawl(spark, [f"{segments}/none*"])
    assert records.isEmpty() and told.isEmpty()


def test_responses_give_html(spark, tmp_path):
    http = lambda kind, body: f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
    bodies = [http("text/html; charset=latin-1", "<p>né</p>".encode("latin-1")), http("image/png", b"\x89PNG"), http("text/html", '<meta charset="utf-8">é'.encode()), http("text/html; charset=nonsense", b"x"), b"no headers"]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(record("response", b, i)) for i, b in enumerate(bodies)) + gzip.compress(record("request", b"GET /", "q")))
    records, told = warc.crawl(spark, [str(tmp_path / "x.warc.gz")], fmt="warc")
    assert {(r.source_record_id, r.text) for r in records.collect()} == {("urn:uuid:0", "<p>né</p>"), ("urn:uuid:2", '<meta charset="utf-8">é'), ("urn:uuid:3", "x")}
    assert not told.first().failed and told.first().members == 6
    assert [r.register for r in warc.raw_records(records).select("register").distinct().collect()] == ["example.org"]


def test_reading_goes_on_where_it_stopped(segments, monkeypatch):
    path, failures = f"{segments}/a.warc.wet.gz", [0]
    real = warc.file_system

    class Flaky:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.stream.close()

        def seek(self, at):
            self.stream.seek(at)

        def read(self, n):
            failures[0] += 1
            if failures[0] % 3 == 0:
                raise OSError("connection reset")
            return self.stream.read(min(n, 2000))

    class Fs:
        def open_input_file(self, p):
            return Flaky(real(path)[0].open_input_file(p))

    size = real(path)[0].get_file_info(path).size
    monkeypatch.setattr(warc, "file_system", lambda p: (Fs(), real(p)[1]))
    reader = warc.WarcReader({"paths": path, "retries": "500", "pauseSeconds": "0"})
    rows = [r for b in reader.read(warc.Split(path, 0, size, size)) for r in b.to_pylist()]
    stats = rows[-1]
    assert stats["attempts"] > 3 and stats["bytes"] == size and stats["error"] is None
    ids = [r["source_record_id"] for r in rows[:-1]]
    assert len(ids) == len(set(ids)) == stats["records"]
