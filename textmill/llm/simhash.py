"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits.  Two fingerprints with at most 4 differing
bits have a segment with at most 2, and then some value lies within one bit of both of
their segments: so every fingerprint files under the small Hamming ball (itself and 32
neighbours) of each segment, rows that meet in a table are the candidates, and complete
distances are verified.

Large groups of near copies would meet in all pairs.  Therefore fingerprints that share
a neighbour in the full 64-bit ball (65 values) are linked first, to the smallest that
files there: they differ in 2 bits at most, so no verification and no pairs are needed.
The tables then only pair fingerprints of different groups; places where one group
alone meets are dropped by a window before the join, so filed rows move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.components import components
from textmill.llm.runtime import dealt, map_batches, staged

SEGMENT_BITS = 32
MAX_DISTANCE = 4


def _fingerprint(text: bytes, shingle_words: int, seed: int) -> int:
    """Majority of the bits of all shingles' XXH64, as an unsigned number."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle_words:
        spans = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        spans = [line[a:b] for a, b in zip(begins[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in spans), np.uint64, len(spans))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * _column_sums(bits) > len(spans)).tobytes(), "big")


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns; runs of 255 rows are summed in bytes first."""
    full = len(bits) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += np.add.reduce(bits[:full].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, *, shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row's whole text; nothing is shuffled.

    Words are lower-cased in A-Z only and shingles repeat as they do in the text; fewer
    words than a shingle give one shingle, none (null, empty or blank text) give 0.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.fromiter((_fingerprint(t.as_py() or b"", shingle_words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))], schema=schema)

    return docs.select("doc_id", "text").transform(map_batches, rows, "doc_id long, fp long")


def _ball(value: Column, bits: int) -> Column:
    """The value and its neighbours at one bit."""
    masks = [0, *((1 << b) - (1 << 64) * (b == 63) for b in range(bits))]
    return F.array(*[value.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def _near(fps: DataFrame) -> DataFrame:
    """Pairs that are linked by a common neighbour in the full ball: a chain to the smallest of each place."""
    filed = dealt(fps, "fp").select("fp", F.explode(_ball(F.col("fp"), 64)).alias("place"))
    # a window, as an aggregate and a join would move the filed rows twice once the places do not fit a broadcast
    return filed.withColumn("a", F.min("fp").over(Window.partitionBy("place"))).where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def _across(grouped: DataFrame, max_distance: int) -> DataFrame:
    """Pairs of groups that hold fingerprints within max_distance: (fp, comp) to group pairs (a, b)."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    # the table's number is kept in bit 32, which no 32-bit segment uses
    tables = F.flatten(F.array(_ball(low, SEGMENT_BITS), _ball(high.bitwiseOR(F.lit(1 << SEGMENT_BITS)), SEGMENT_BITS)))
    filed = dealt(grouped, "fp").select("fp", "comp", F.explode(tables).alias("place"))
    place = Window.partitionBy("place")
    # as in _near
    met = staged(filed.withColumns({"least": F.min("comp").over(place), "top": F.max("comp").over(place)}).where("least != top"), "simhash-met")
    left = met.where("comp != least").select("place", F.col("fp").alias("fp_a"), F.col("comp").alias("b"))
    right = met.where("comp != top").select("place", F.col("fp").alias("fp_b"), F.col("comp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_distance)
    joined = left.join(right, (left["place"] == right["place"]) & near)
    return joined.select("a", "b").distinct()


def fingerprint_groups(fps: DataFrame, *, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, comp) of every distinct fp; comp is the smallest fp reachable over links of max_distance (2 to 5) bits."""
    if not 2 <= max_distance <= 5:
        raise ValueError("two segments with balls of one bit find distances of 2 to 5")
    distinct = staged(fps.select("fp").distinct(), "simhash-fps")
    first = components(_near(distinct), "simhash-near")
    grouped = distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp"))
    grouped = staged(grouped, "simhash-grouped")
    second = components(_across(grouped, max_distance), "simhash-across")
    return grouped.join(second.select(F.col("node").alias("comp"), "component"), "comp", "left").select("fp", F.coalesce("component", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, *, shingle_words: int = 5, seed: int = 42, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links, itself included) of every row of docs.

    Documents link where fingerprints differ in max_distance bits or fewer, and links
    chain.  Null and blank texts have fingerprint 0 and link like any other.  Repeated
    rows and equal doc_ids stand as they are.  An empty table gives no rows.
    """
    fps = staged(fingerprints(docs, shingle_words=shingle_words, seed=seed), "simhash-docs")
    groups = fingerprint_groups(fps, max_distance=max_distance)
    # the smallest doc_id of each fingerprint, then of each group: aggregated before any join
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    named = groups.join(least, "fp")
    heads = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return fps.join(named.join(heads, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
