"""Repeated passages by compaction of a De Bruijn graph over words.

An edge of the graph is a window of ``window`` consecutive words, a node what two
neighbouring windows share.  Edges are not shuffled one by one.  A document's windows
are cut into runs that have the same minimizer (the word k-mer of least hash that a
window holds), so equal windows always lie in runs of equal minimizers, and a run is a
path of the graph that is compacted from the start.  Then, with Spark aggregates and
joins:

1. minimizers that occur once are dropped, and with them almost all of the corpus;
2. runs of equal content are one path with a first source coordinate; every later
   occurrence is a repeat as a whole;
3. where a minimizer has paths of several contents (the graph branches inside them),
   only their first occurrences are opened into single edges, and each edge gets its
   first source coordinate;
4. repeats that follow each other on the same diagonal (same source document, same
   distance) are compacted into long spans, which are verified by comparing the words
   at the span and at its source coordinates.

Counts of a hot passage are combined before every shuffle, and only one row for each
distinct content takes part in step 3, so thousands of copies cost as many rows as they
have runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import words as W
from textmill.llm.runtime import bound_batches, map_batches, staged

WINDOW = 20
MINIMIZER_WORDS = 4
_SECOND_BASE = 0xA24BAED4963EE407
_OTHER_WORD_BASE = 0x9FB21C651E98DF25


def _runs(w: W.Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, minimizer, content) of every run of w."""
    hashes = w.hashes()
    empty = np.zeros(0, dtype=np.int64)
    if len(hashes) < window:
        return empty, empty, empty, empty, empty
    g = W.grams(hashes, k)
    # the least upper half of a hash, at its first place; places fit the lower half
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, have = window - k + 1, 1
    least = key
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = span - have
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    whole = w.row[: len(hashes) - window + 1] == w.row[window - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return empty, empty, empty, empty, empty
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    content = _spans(hashes, begin, begin + count + window - 1, _OTHER_WORD_BASE)
    row = w.row[begin]
    return row, begin - w.first()[row], count, g[place[new]].view(np.int64), content.view(np.int64)


def _spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of word ranges."""
    power, inverse = W._powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return W.mix((total[end] - total[begin]) * inverse[begin])


def runs(docs: DataFrame, window: int, k: int) -> DataFrame:
    """doc_id, start, n, m (minimizer) and c (content) of every run."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("m", pa.int64()), ("c", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.batches(batch.column("text")):
                row, start, n, m, c = _runs(w, window, k)
                ids = batch.column("doc_id").slice(a, b - a).cast(pa.int64()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(m), pa.array(c)], schema=schema)

    return docs.select("doc_id", "text").transform(map_batches, rows, "doc_id long, start int, n int, m long, c long")


def _asked(docs: DataFrame, asked: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with the list of what is asked of each; a list is no longer than its document has words or sources have spans."""
    lists = asked.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct(*[c for c in asked.columns if c != "doc_id"])).alias("asked"))
    return docs.select("doc_id", "text").join(lists, F.col("doc_id").eqNullSafe(F.col("of")), how).drop("of")


def _edges(docs: DataFrame, opened: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc_id, start of each window of the runs (doc_id, start, n)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.batches(batch.column("text")):
                first, one = w.first(), w.hashes()
                if len(one) < window:
                    continue
                asked = batch.column("asked").slice(a, b - a)
                per_row = np.diff(np.asarray(asked.offsets)) if len(asked) else np.zeros(0, dtype=np.int64)
                flat = asked.flatten()
                row = np.repeat(np.arange(b - a), per_row)
                start, n = (np.asarray(flat.field(f)).astype(np.int64) for f in ("start", "n"))
                begin = np.repeat(first[row] + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                h1 = W.grams(one, window)[begin]
                h2 = W.grams(w.hashes(_SECOND_BASE), window, _OTHER_WORD_BASE)[begin]
                ids = batch.column("doc_id").slice(a, b - a).cast(pa.int64()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids, pa.array((begin - first[row]).astype(np.int32))], schema=schema)

    return _asked(docs, opened).transform(map_batches, rows, "h1 long, h2 long, doc_id long, start int")


def _compact(repeats: DataFrame, window: int) -> DataFrame:
    """Join repeats (doc_id, start, n, src_doc, src_start) that overlap or touch on one diagonal: spans of words."""
    diagonal = Window.partitionBy("doc_id", "src_doc", "shift").orderBy("start")
    ends = F.max(F.col("start") + F.col("n")).over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    return (
        repeats.withColumn("shift", F.col("start") - F.col("src_start"))
        .withColumn("new", F.when(F.col("start") <= ends, 0).otherwise(1))
        .withColumn("path", F.sum("new").over(diagonal))
        .groupBy("doc_id", "src_doc", "shift", "path")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n") + (window - 1)).alias("end"))
        .select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "src_doc", (F.col("start") - F.col("shift")).alias("src_start"))
    )


def _verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are those at their source coordinates."""
    ask = spans.select("doc_id", "start", "length").unionByName(spans.select(F.col("src_doc").alias("doc_id"), F.col("src_start").alias("start"), "length")).distinct()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("asked"), strict=True):
                words = (text.as_py() or b"").split()
                for x in asked.as_py():
                    part = b" ".join(words[x["start"] : x["start"] + x["length"]])
                    for column, v in zip(out, (doc, x["start"], x["length"], hashlib.blake2b(part, digest_size=16).digest()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    digests = staged(_asked(docs, ask).transform(map_batches, rows, "doc_id long, start int, length int, digest binary"), "substrings-digests").distinct()

    def at(name: str) -> DataFrame:
        return digests.select(*[F.col(c).alias(f"{name}_{c}") for c in digests.columns])

    def same(name: str, doc: str, start: str) -> Column:
        return F.col(doc).eqNullSafe(F.col(f"{name}_doc_id")) & (F.col(start) == F.col(f"{name}_start")) & (F.col("length") == F.col(f"{name}_length"))

    told = spans.join(at("here"), same("here", "doc_id", "start")).join(at("there"), same("there", "src_doc", "src_start"))
    return told.where("here_digest = there_digest").select("doc_id", "start", "length", "src_doc", "src_start")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, minimizer_words: int = MINIMIZER_WORDS) -> DataFrame:
    """Spans of words (doc_id, start, length, src_doc, src_start) whose windows also start earlier: in a smaller doc_id, or earlier in the same document.

    A span's words equal those at (src_doc, src_start), its source; spans of a document
    may overlap.  Words are runs outside ``\\x20 \\x09-\\x0D``, compared byte for byte.
    Null, empty and short texts have no windows.  doc_id is the key of docs: rows that
    repeat a doc_id (null among them) are taken for one document, and are no repeats of
    each other where their windows start at the same place.  A null doc_id counts as
    smallest.  An empty table gives no rows; other columns are ignored.
    """
    found = runs(docs, window, minimizer_words)
    # written, so that both sides of the joins below are plain shuffles, whose hot keys Spark can split
    often = staged(found.groupBy("m").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("m"), "substrings-often")
    shared = staged(found.join(often, "m"), "substrings-shared")
    paths = staged(shared.groupBy("m", "c", "n").agg(F.min(F.struct("doc_id", "start")).alias("first")), "substrings-paths")
    whole = shared.join(paths, ["m", "c", "n"]).where(F.struct("doc_id", "start") != F.col("first"))
    branching = staged(paths.groupBy("m").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("m"), "substrings-branching")
    opened = paths.join(branching, "m").select("first.doc_id", "first.start", "n")
    edges = staged(_edges(docs, opened, window), "substrings-edges")
    first = edges.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    single = edges.join(first, ["h1", "h2"]).where(F.struct("doc_id", "start") != F.col("first"))
    columns = ("doc_id", "start", "n", F.col("first.doc_id").alias("src_doc"), F.col("first.start").alias("src_start"))
    repeats = whole.select(*columns).unionByName(single.withColumn("n", F.lit(1)).select(*columns))
    return _verified(docs, staged(_compact(repeats, window), "substrings-spans"))


def _union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are covered."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, np.minimum(starts, n), 1)
    np.add.at(cover, np.minimum(starts + lengths, n), -1)
    return np.cumsum(cover[:-1]) > 0


def _kept(docs: DataFrame, spans: DataFrame, emit, schema: pa.Schema, ddl: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), batch.column("asked"), strict=True):
                raw, asked = text.as_py(), asked.as_py()
                for column, v in zip(out, emit(doc, raw, asked or ()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return _asked(docs, spans.select("doc_id", "start", "length"), "left").transform(map_batches, rows, ddl)


def _split_kept(raw: bytes | None, asked) -> tuple[list[bytes], list[bytes]]:
    words = (raw or b"").split()
    if not asked:
        return words, words
    gone = _union(np.array([x["start"] for x in asked]), np.array([x["length"] for x in asked]), len(words))
    return words, [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def removal_digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs after the spans' words are taken out."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def emit(doc, raw, asked):
        words, kept = _split_kept(raw, asked)
        return doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _kept(docs, spans, emit, schema, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept_text(raw: bytes, asked) -> bytes:
    """The runs of kept words as they stand in the text, joined by one space."""
    w = W.split(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    gone = _union(np.array([x["start"] for x in asked]), np.array([x["length"] for x in asked]), len(w.starts))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return b" ".join(raw[w.starts[a] : w.ends[b - 1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the words of repeated_spans taken out of their texts, and n_chars (where there is one) of what is left.

    Texts without a repeat, nulls among them, stay as they are, as do all other columns,
    whatever their names; a text that is all repeats becomes empty.  Rows that repeat a
    doc_id are cut alike.  An empty table stays empty.
    """
    spans = repeated_spans(docs, **options)
    # a name that no column of docs has
    asked = "asked_" + "_".join(docs.columns)
    lists = spans.groupBy(F.col("doc_id").alias(f"{asked}_of")).agg(F.collect_list(F.struct("start", "length")).alias(asked))
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(text: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([t if a is None or t is None else _kept_text(t.encode(), a).decode() for t, a in zip(text, asked, strict=True)], dtype=object)

    new = docs.join(lists, F.col("doc_id").eqNullSafe(F.col(f"{asked}_of")), "left").withColumn("text", cut("text", asked))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(asked).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)
