"""Crawl segments (WET and WARC) as a Spark data source.

A segment is a chain of gzip members, one for each record.  It is cut into splits of
bytes; a split reads the members that begin in it, so a segment of any size is read in
parallel, and a task holds one record and one chunk.  After a failed read a task goes on at
the member where it stopped, so no record comes twice.

Every split ends with a row of kind ``stats``: members, bytes, records, attempts and what
went wrong.  The bytes of a segment's splits add up to its length only if it was read to
its end, so a segment that is cut short or corrupt is told from a whole one by a positive
check.  crawl() returns the records of whole segments and one row for each segment.
"""

from __future__ import annotations

import fnmatch
import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textmill.operators.tables import checkpointed

SCHEMA = (
    "kind string, path string, start long, source_record_id string, url string, date string, language string, media string, text string, "
    "members long, bytes long, records long, attempts int, error string"
)
#: Types of the records that are documents, by format.
WANTED = {"wet": "conversion", "warc": "response"}
SPLIT_BYTES, CHUNK, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
#: A member that unpacks to more is an error: no record may fill a task.
RECORD_BYTES = 256 << 20
_MAGIC = b"\x1f\x8b\x08"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
_CHARSET = re.compile(rb"charset=[\"']?([A-Za-z0-9_.:-]+)", re.I)


class SegmentError(Exception):
    """A segment that is not what it should be; reading it again does not help."""


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int

    def __init__(self, path: str, start: int, end: int, size: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.size = path, start, end, size


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files in a folder, or of those that a pattern in the last part of a path matches; -1 bytes for a file that is not there."""
    folder, _, last = path.rpartition("/")
    pattern = last if re.search(r"[*?\[]", last) else None
    fs, at = file_system(folder if pattern else path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        return [] if pattern else [(path, -1)]
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    head = folder if pattern else path.rstrip("/")
    files = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f"{head}/{f.base_name}", f.size) for f in files if not pattern or fnmatch.fnmatchcase(f.base_name, pattern))


class Members:
    """Gzip members of a file, from the first that begins at or after start to the last that begins before end."""

    def __init__(self, stream: pa.NativeFile, start: int, end: int, size: int):
        self.stream, self.at, self.end, self.size = stream, start, end, size
        self.held, self.held_at = b"", start

    def _bytes(self, at: int, n: int) -> bytes:
        """n bytes at a place, fewer at the end of the file."""
        if not self.held_at <= at or at + n > self.held_at + len(self.held):
            self.stream.seek(at)
            self.held, self.held_at = self.stream.read(max(n, CHUNK)), at
        return self.held[at - self.held_at : at - self.held_at + n]

    def align(self) -> bool:
        """Go to the first member at or after this place; False if none begins in the split."""
        while self.at < self.end:
            chunk = self._bytes(self.at, min(CHUNK, self.size - self.at))
            k = chunk.find(_MAGIC)
            if k < 0:
                self.at += max(1, len(chunk) - len(_MAGIC) + 1)
                continue
            self.at += k
            if self.at < self.end and self._begins(self.at):
                return True
            self.at += 1
        return False

    def _begins(self, at: int) -> bool:
        """Whether a record's member begins here: these bytes may stand within a member too, but what follows would not unpack to a record."""
        try:
            return zlib.decompressobj(31).decompress(self._bytes(at, 4096), 5) == b"WARC/"
        except zlib.error:
            return False

    def __iter__(self) -> Iterator[bytes]:
        """Unpacked members; self.at is past the last that came whole."""
        while self.at < self.end:
            unpack, place, parts, total = zlib.decompressobj(31), self.at, [], 0
            while not unpack.eof:
                chunk = self._bytes(place, min(CHUNK, self.size - place))
                if not chunk:
                    raise SegmentError(f"the segment ends inside the record at byte {self.at}")
                try:
                    parts.append(unpack.decompress(chunk, RECORD_BYTES + 1 - total))
                except zlib.error as e:
                    raise SegmentError(f"the record at byte {self.at} does not unpack: {e}") from e
                total += len(parts[-1])
                if total > RECORD_BYTES:
                    raise SegmentError(f"the record at byte {self.at} has more than {RECORD_BYTES} bytes")
                place += len(chunk) - len(unpack.unused_data) - len(unpack.unconsumed_tail)
            self.at = place
            yield b"".join(parts)


class Plain:
    """Records of a file that is not packed, in one split."""

    def __init__(self, stream: pa.NativeFile, start: int, end: int, size: int):
        self.stream, self.at, self.end, self.size = stream, start, end, size

    def align(self) -> bool:
        return self.at < self.end

    def __iter__(self) -> Iterator[bytes]:
        while self.at < self.size:
            self.stream.seek(self.at)
            head = self.stream.read(1 << 16)
            k = head.find(b"\r\n\r\n")
            length = re.search(rb"^content-length:\s*(\d+)", head[: max(k, 0)], re.I | re.M)
            if k < 0 or not length or int(length[1]) > RECORD_BYTES:
                raise SegmentError(f"no record begins at byte {self.at}")
            n = k + 4 + int(length[1])
            self.stream.seek(self.at)
            record = self.stream.read(n + 4)
            if len(record) < n:
                raise SegmentError(f"the segment ends inside the record at byte {self.at}")
            self.at += n + (4 if record[n:] == b"\r\n\r\n" else 0)
            yield record[:n]


def parsed(record: bytes, fmt: str) -> tuple | None:
    """(source_record_id, url, date, language, media, text) of a record that is a document, else None.

    A response gives its HTML body; one that is no HTML, and blank text, is no document.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise SegmentError("a member is no record")
    headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
    if headers.get("warc-type") != WANTED[fmt]:
        return None
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise SegmentError("a record is shorter than its length")
    body, media = rest[: int(length)], "text/plain"
    if fmt == "warc":
        answer, _, body = body.partition(b"\r\n\r\n")
        kind = re.search(rb"^content-type:\s*([^\r\n]*)", answer, re.I | re.M)
        media = kind[1].split(b";")[0].strip().decode("ascii", "replace").lower() if kind else ""
        if media not in ("text/html", "application/xhtml+xml"):
            return None
        charset = _CHARSET.search(kind[1]) or _CHARSET.search(body[:2048])
        try:
            text = body.decode(charset[1].decode() if charset else "utf-8", "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
    else:
        text = body.decode("utf-8", "replace")
    if not text.strip():
        return None
    return headers.get("warc-record-id", "").strip("<>") or None, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-identified-content-language"), media, text


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.fmt = options.get("fmt", "wet")
        self.split, self.retries, self.pause = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("retries", 4)), float(options.get("pauseSeconds", 5))
        if self.fmt not in WANTED:
            raise ValueError(f"fmt must be one of {sorted(WANTED)}")

    def partitions(self) -> list[Split]:
        found = []
        for path, size in sorted({f for p in self.paths for f in listed(p)}):
            step = self.split if path.endswith(".gz") else max(size, 1)
            found += [Split(path, a, min(a + step, size), size) for a in range(0, max(size, 1), step)]
        # Spark asks for one partition at least
        return found or [Split("", 0, 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        reading = Members if part.path.endswith(".gz") else Plain
        rows, held, told = [], 0, {"members": 0, "records": 0, "attempts": 0, "error": None}
        first, at, last = None, part.start, None
        while True:
            told["attempts"] += 1
            try:
                if part.size < 0:
                    raise SegmentError("the segment is not there")
                fs, place = file_system(part.path)
                with fs.open_input_file(place) as stream:
                    members = reading(stream, at, part.end, part.size)
                    # the file's first member begins at 0, whatever it is; later splits look for theirs
                    begins = at > part.start or part.start == 0 or members.align()
                    first = members.at if first is None else first
                    if begins:
                        for record in members:
                            if document := parsed(record, self.fmt):
                                rows.append(("record", part.path, part.start, *document, *[None] * 5))
                                told["records"] += 1
                                held += len(document[-1])
                            told["members"] += 1
                            at = members.at
                            if held > BATCH_BYTES:
                                yield self._batch(rows)
                                rows, held = [], 0
                    last = members.at if begins else part.end
                break
            except SegmentError as e:
                told["error"] = str(e)
                break
            except OSError as e:
                if told["attempts"] > self.retries:
                    told["error"] = f"{type(e).__name__}: {e}"
                    break
                time.sleep(min(self.pause * 2 ** (told["attempts"] - 1), 60))
        # a split answers for the bytes of its members, which reach beyond its end
        read = last - first if not told["error"] and begins else 0
        rows.append(("stats", part.path, part.start, *[None] * 6, told["members"], read, told["records"], told["attempts"], told["error"]))
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """spark.read.format("warc").option("fmt", "wet" or "warc").load(path): records and stats of splits, as SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def crawl(spark: SparkSession, paths: list[str], *, fmt: str = "wet", split_bytes: int = SPLIT_BYTES, retries: int = 4, pause: float = 5.0, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, segments) of crawl segments: files, folders or patterns.

    records: path, source_record_id, url, date, language, media and text of the documents
    of whole segments; of others nothing is kept.  segments: one row for each segment with
    path, bytes (read), size, members, records, attempts, failed and error.  declared
    (path, bytes) tells lengths that segments must have.  A segment fails if a record does
    not unpack or is cut off, if the bytes of its records are not its size or not what was
    declared, or if it can't be opened; the others are not touched by it.  An empty file is
    a segment without records.
    """
    spark.dataSource.register(WarcSource)
    read = spark.read.format("warc").options(fmt=fmt, splitBytes=split_bytes, retries=retries, pauseSeconds=pause, paths="\n".join(paths)).load()
    files = sorted({f for p in paths for f in listed(p)})
    sizes = spark.createDataFrame(files, "path string, size long")
    rows = checkpointed(read, "crawl")
    stats = rows.where("kind = 'stats'").groupBy("path").agg(*[F.sum(c).alias(c) for c in ("members", "bytes", "records")], F.max("attempts").alias("attempts"), F.min("error").alias("error"))
    found = stats.join(sizes, "path")
    if declared is not None:
        found = found.join(declared.select("path", F.col("bytes").alias("declared")), "path", "left")
    else:
        found = found.withColumn("declared", F.lit(None).cast("long"))
    cut = F.when(F.col("bytes") != F.col("size"), F.concat(F.lit("read "), "bytes", F.lit(" of "), "size", F.lit(" bytes")))
    short = F.when(F.col("size") != F.col("declared"), F.concat(F.lit("has "), "size", F.lit(" of "), "declared", F.lit(" bytes")))
    found = checkpointed(found.withColumn("error", F.coalesce("error", cut, short)).withColumn("failed", F.col("error").isNotNull()), "crawl-segments")
    whole = found.where("not failed").select("path")
    records = rows.where("kind = 'record'").join(whole, "path", "left_semi").select("path", "source_record_id", "url", "date", "language", "media", "text")
    return records, found.select("path", "bytes", "size", "members", "records", "attempts", "failed", "error")


def raw_records(records: DataFrame, license: str = "ODC-By-1.0") -> DataFrame:
    """records as raw records of the cleaning funnel: source_id, source_record_id, text, license, domain, register."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return records.select(F.lit("cc").alias("source_id"), "source_record_id", "text", F.lit(license).alias("license"), F.lit("web").alias("domain"), F.nullif(host, F.lit("")).alias("register"))
