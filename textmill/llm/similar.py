"""Near-duplicate documents by SimHash multi-index hashing, completed by an exact prefix index.

Documents are near where their sets of word shingles have at least the Jaccard similarity
asked for.  Two indexes offer pairs, and every pair is verified on the shingle sets:

1. A prefix index, which misses no pair.  A document of n shingles files under the first
   n - ceil(similarity * n) + 1 of them, in one order of all shingles.  Two sets that are
   similar enough have a common shingle among these, whatever the order is.  Shingles that
   stand in many documents come last in the order, so a passage that many documents share
   is a key of those alone that have little else.  Which shingles these are is counted over
   all documents: one that stands twice in some window of a task, as any that is common
   must, is sent on with its count.  The commonest ORDERED (8 bytes each) are broadcast.
   They move the order, never the result.
2. SimHash fingerprints (64 bits over the shingles) of the documents that share a key:
   every one files under a small Hamming ball of each of its two segments, and each is
   compared with the leader of the places where it stands.  That joins most copies at once.

In a large group of copies not all pairs are compared: the groups that leaders join are
contracted, first by SimHash places, then by keys in a few rounds; then all documents of
different groups that still share a key are compared, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import words as W
from textmill.llm.components import components
from textmill.llm.runtime import map_batches, staged
from textmill.llm.simhash import SEGMENT_BITS, _ball

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of a document and a SimHash leader may differ, to be compared.
MAX_DISTANCE = 5
#: Rounds of comparison with the leaders of keys, before all that is left is compared.
ROUNDS = 1
#: Shingles that a task looks through at once for those that stand in several documents.
COUNTED = 1 << 21
#: Common shingles that are broadcast at most, the commonest ones.
ORDERED = 1 << 19
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _shingles(w: W.Words, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row and their rows, by row and hash; fewer words than a shingle are one."""
    hashes, first = w.hashes(), w.first()
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < shingle_words))
    parts = [W.grams(hashes[first[i] : first[i + 1]], count[i]) for i in short]
    rows = [short]
    if len(hashes) >= shingle_words:
        own = w.row[shingle_words - 1 :] == w.row[: len(w.row) - shingle_words + 1]
        parts.append(W.grams(hashes, shingle_words)[own])
        rows.append(w.row[: len(own)][own])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shingle, row = np.concatenate(parts), np.concatenate(rows).astype(np.int64)
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    return shingle[new], row[new]


def _fingerprints(shingle: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The 64-bit SimHash of each row's distinct shingles; 0 without any."""
    out = np.zeros(rows, dtype=np.uint64)
    if len(shingle):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        count = np.diff(np.append(starts, len(row)))
        bits = np.unpackbits(shingle.astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[row[starts]] = np.packbits(2 * votes > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _wholes(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of each row's whole word sequence."""
    hashes, first = w.hashes(), w.first()
    out = []
    for base in (int(_OTHER), 0xA24BAED4963EE407):
        power, inverse = W._powers(base, len(hashes) + 1)
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=total[1:])
        out.append(W.mix((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]]) ^ np.diff(first).astype(np.uint64))
    return out[0], out[1]


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Two kinds of rows; nothing is shuffled.

    n null: doc_id, fp (SimHash), w0 and w1 (hash of the word sequence) of every row of
    docs.  n not null: a shingle (fp) that stands in n > 1 different texts of a window.
    """
    names = ("doc_id", "fp", "w0", "w1", "n")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, set()

        def common() -> Iterator[pa.RecordBatch]:
            if held:
                shingle, n = np.unique(np.concatenate(held), return_counts=True)
                shingle, n = shingle[n > 1], n[n > 1]
                none = pa.nulls(len(n), pa.int64())
                if len(n):
                    yield pa.RecordBatch.from_arrays([none, pa.array(shingle.view(np.int64)), none, none, pa.array(n.astype(np.int64))], schema=schema)

        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column("text")):
                w = W.split(data, offsets, lower=True, between=W.MARKS)
                shingle, row = _shingles(w, shingle_words)
                w0, w1 = _wholes(w)
                fresh = np.array([x not in texts and not texts.add(x) for x in w0.tolist()], dtype=bool)
                held.append(shingle[fresh[row]])
                size += len(held[-1])
                found = (_fingerprints(shingle, row, b - a), w0, w1)
                ids = batch.column("doc_id").slice(a, b - a).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in found), pa.nulls(b - a, pa.int64())], schema=schema)
                if size > COUNTED:
                    yield from common()
                    held, size, texts = [], 0, set()
        yield from common()

    return docs.select("doc_id", "text").transform(map_batches, rows, ", ".join(f"{n} long" for n in names))


def _commonest(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles (at most ORDERED) in order of their hashes, and the levels (log2) of their counts."""
    level = F.floor(F.log2("n")).cast("int")
    each = staged(counted.groupBy("fp").agg(F.sum("n").alias("n")).select("fp", level.alias("level")), "similar-common")
    room, least = ORDERED, 64
    # a row for each power of two
    for r in each.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    # as Arrow columns: rows of Python objects would be many times as large
    rows = each.where(F.col("level") >= least).toArrow()
    shingle = rows["fp"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], rows["level"].to_numpy().astype(np.int8)[order]


def _levels(shingle: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(common[0]):
        return np.zeros(len(shingle), dtype=np.int8)
    at = np.minimum(np.searchsorted(common[0], shingle), len(common[0]) - 1)
    return np.where(common[0][at] == shingle, common[1][at], 0).astype(np.int8)


def _prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle_words: int, similarity: float) -> DataFrame:
    """doc_id, n (size of the shingle set) and keys (its prefix, in the common order) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(common)
    share = Fraction(str(similarity))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column("text")):
                shingle, row = _shingles(W.split(data, offsets, lower=True, between=W.MARKS), shingle_words)
                n = np.bincount(row, minlength=b - a)
                size = np.where(n > 0, n + (-n * share.numerator // share.denominator) + 1, 0)
                order = np.lexsort((shingle, _levels(shingle, sent.value), row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                keys = shingle[order][place < np.repeat(size, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int32()), lists], schema=schema)

    return docs.select("doc_id", "text").transform(map_batches, rows, "doc_id long, n int, keys array<long>")


def _shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """node and shingles (its distinct 32-bit hashes in order, as bytes) of docs."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column("text")):
                shingle, row = _shingles(W.split(data, offsets, lower=True, between=W.MARKS), shingle_words)
                # the upper half keeps the order of the whole
                edges = np.searchsorted(row, np.arange(b - a + 1))
                half = (shingle >> np.uint64(32)).astype(np.uint32)
                sets = [half[i:j].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").transform(map_batches, rows, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum()) if len(y) else 0
                ok.append(both > 0 and both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("a", "b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").transform(map_batches, rows, "a long, b long")


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _places_allow(a: str, b: str, similarity: float) -> Column:
    """Whether two documents that share a key can be similar; columns begin with a and b.

    seen: keys before this one that any other group has too; at: its place among all
    shingles in order; n: shingles.  What the two share before the key is in both runs of
    keys seen, what they share from it on in both rests; twice that must reach the share
    of both sizes that the similarity asks for.
    """
    before = F.least(f"{a}seen", f"{b}seen")
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}at"), F.col(f"{b}n") - F.col(f"{b}at"))
    return (before + rest) * (1 + similarity) >= similarity * (F.col(f"{a}n") + F.col(f"{b}n")) - 1e-6


def _contracted(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) with the groups that links join made one."""
    ends = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c")) for c in ("a", "b")]
    pairs = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ac").alias("a"), F.col("bc").alias("b"))
    joined = components(pairs, "similar-components").select(F.col("node").alias("comp"), F.col("component").alias("to"))
    return staged(comps.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "similar-groups")


def _mixed(met: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of met (key, node, n, at) under keys that still hold several groups, with comp; groups only grow, so the others are done with."""
    own = met.select("key", "node", "n", "at").join(comps.hint("merge"), "node")
    ends = own.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("top")).where("least != top")
    # a node has no more keys than words
    seen = F.row_number().over(Window.partitionBy("node").orderBy("at")) - 1
    return staged(own.join(ends.hint("merge"), "key").withColumn("seen", seen), "similar-met")


def _led_by_fingerprint(nodes: DataFrame, max_distance: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp, n) with the leader of a SimHash place, within max_distance bits.

    A place's leader is its smallest node; a large place has one, so pairs grow with the
    nodes.
    """
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS).bitwiseOR(F.lit(1 << SEGMENT_BITS))
    places = F.flatten(F.array(_ball(low, SEGMENT_BITS), _ball(high, SEGMENT_BITS)))
    # dealt out first, so that no task explodes many rows
    filed = nodes.repartition("node").select("node", "fp", "n", F.explode(places).alias("place"))
    lead = filed.groupBy("place").agg(F.min(F.struct(F.col("node").alias("b"), F.col("fp").alias("fb"), F.col("n").alias("nb"))).alias("lead"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fb"))) <= max_distance
    met = filed.join(lead.hint("merge"), "place").where((F.col("node") != F.col("lead.b")) & near & _sizes_allow("n", "lead.nb", similarity))
    return met.select(F.col("node").alias("a"), F.col("lead.b").alias("b")).distinct()


def _led_by_key(met: DataFrame, similarity: float) -> DataFrame:
    """A pair (a, b) of each node of met with one leader of its keys in another group.

    A key's leader is the node that has fewest shingles before it, which in a crowd of
    copies is one that was changed little; of a node's leaders the one counts that leads
    most of its keys.
    """
    columns = ("at", "node", "comp", "n", "seen")
    lead = met.groupBy("key").agg(F.min(F.struct(*columns)).alias("lead"))
    led = met.join(lead, "key").select("*", *[F.col(f"lead.{c}").alias(f"b_{c}") for c in columns])
    led = led.where((F.col("comp") != F.col("b_comp")) & _places_allow("", "b_", similarity))
    counts = led.groupBy("node", "b_node").agg(F.count(F.lit(1)).alias("keys"))
    chosen = counts.groupBy("node").agg(F.max(F.struct("keys", (-F.col("b_node")).alias("turn"), F.col("b_node").alias("b"))).alias("lead"))
    return chosen.select(F.col("node").alias("a"), "lead.b")


def _across(met: DataFrame, similarity: float) -> DataFrame:
    """All pairs of nodes of different groups that share a key and whose sizes and places allow the similarity, each once."""
    columns = ("node", "comp", "n", "at", "seen")
    left = met.where("comp != top").select(F.col("key").alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = met.where("comp != least").select(F.col("key").alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in columns])
    allowed = (F.col("a_comp") < F.col("b_comp")) & _places_allow("a_", "b_", similarity)
    return left.join(right, (F.col("a_key") == F.col("b_key")) & allowed).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def similar_groups(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, max_distance: int = MAX_DISTANCE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id and component_id (smallest doc_id of its group) of every row of docs.

    Words are runs of letters and digits, lower-cased; shingles are sets; fewer words than
    a shingle are one shingle.  Every pair of documents at the similarity or above is
    linked (sets are compared as 32-bit hashes), and links chain.  Documents without words
    (null, empty, blank) are each a group of their own unless their doc_ids are equal.
    doc_id is the key of docs: rows that repeat it are one document.  Null doc_ids are a
    group of their own.  An empty table gives no rows.  Other columns are ignored.
    """
    read = staged(fingerprints(docs, shingle_words), "similar-prints")
    found = read.where("n is null").select("doc_id", "fp", "w0", "w1")
    common = _commonest(read.where("n is not null").select("fp", "n"))
    wordless = F.when(F.col("w0") == _EMPTY, F.col("doc_id"))
    # 32 hex digits and the doc_id of a text without words tell texts apart
    named = found.withColumn("alone", wordless)
    nodes = staged(named.groupBy("w0", "w1", "alone").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp")).where("node is not null"), "similar-texts")
    prints = nodes.where("alone is null").select("node", "fp")
    keyed = _prefixes(docs, common, shingle_words, similarity).withColumnRenamed("doc_id", "node")
    one = keyed.join(prints.select("node").hint("merge"), "node", "left_semi")
    filed = one.select("node", "n", F.posexplode("keys").alias("at", "key"))
    shared = filed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("top")).where("least != top")
    met = staged(filed.join(shared.hint("merge"), "key").select("key", "node", "n", "at"), "similar-met")
    sized = staged(met.groupBy("node").agg(F.max("n").alias("n")).join(prints.hint("merge"), "node"), "similar-nodes")
    comps = sized.select("node", F.col("node").alias("comp"))
    # both steps are on doc_id, so texts move once
    texts = docs.select("doc_id", "text").join(sized.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = staged(_shingle_sets(texts, shingle_words), "similar-sets")
    comps = _contracted(comps, _verified(_led_by_fingerprint(sized, max_distance, similarity), sets, similarity))
    met = _mixed(met, comps)
    for _ in range(rounds):
        comps = _contracted(comps, _verified(_led_by_key(met, similarity), sets, similarity))
        met = _mixed(met, comps)
    comps = _contracted(comps, _verified(_across(met, similarity), sets, similarity))
    keys = ("w0", "w1", "alone")
    groups = nodes.join(comps, "node", "left").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce("comp", "node").alias("component_id"))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return named.join(groups, same[0] & same[1] & same[2], "left").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, but one document (the smallest doc_id) of each group of similar_groups.

    Rows without a doc_id stay; rows that repeat a doc_id stay or go together.
    """
    gone = similar_groups(docs, **options).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


#: The word sequence's hash of a text without words.
_EMPTY = int(W.mix(np.zeros(1, np.uint64)).view(np.int64)[0])
