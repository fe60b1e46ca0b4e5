"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of test items.

The index holds the test items; every passage of every training document is a query.
Terms are runs of letters and digits, lower-cased.  Spark counts terms, document
frequencies and lengths over all items and writes the postings (term, item, impact).  An
item's threshold is a share of the score that it gives to itself, and impacts are divided
by it, so that an item is retrieved where its impacts add up to 1.

Items are numbered by length and stand in blocks of FANOUT, these in blocks of FANOUT
blocks, and so on.  Every posting list has the largest impact of its term in each block.
A passage whose terms' largest impacts together stay under 1 has no pivot and is skipped;
others descend block by block, always into those alone whose maxima reach 1, down to the
items, all of which are retrieved.  Retrieved items are verified on the words: enough of
the question's and of the answer's word shingles must stand in the document near the
passage.

What is broadcast is one part of the index: PART_POSTINGS postings at most, and those of
one more item.  More items make more parts, each with the statistics of all, so scores and
results do not depend on the number of parts; documents are read once for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import words as W
from textmill.llm.runtime import bound_batches, map_batches, staged

K1, B = 1.2, 0.75
FANOUT = 64
#: Share of an item's own score from which it is retrieved, and shares of shingles from which it is a leak.
RETRIEVE, QUESTION, ANSWER = 0.5, 0.5, 0.5
SHINGLE = 5
#: Words of half a passage at least; two halves make a passage, so neighbouring passages share one.
HALF = 64
#: Postings of one part of the index (some 50 bytes each, with blocks and shingles).
PART_POSTINGS = 2_000_000
#: What sums of impacts may fall short of 1 by rounding.
_ROUNDING = 1e-9
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _terms(texts: list[str]) -> W.Words:
    data, offsets = next(W.slices(pa.array(texts, pa.string()), limit=1 << 40))[2:]
    return W.split(data, offsets, lower=True, between=W.MARKS)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; one sentence is both."""
    parts = [p for p in _SENTENCE.split(text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _shingles(text: str) -> np.ndarray:
    """Distinct hashes of the word shingles; fewer words than a shingle are one."""
    hashes = _terms([text]).hashes()
    return np.unique(W.grams(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else hashes


ITEM = "item_id long, length long, terms array<long>, tf array<long>, question array<long>, answer array<long>"


def _parsed(benchmark: DataFrame) -> DataFrame:
    """ITEM rows of the items that have a term."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("item_id", pa.int64()), ("length", pa.int64()), ("terms", longs), ("tf", longs), ("question", longs), ("answer", longs)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = _terms([text]).hashes() if text else ()
                if len(hashes):
                    term, tf = np.unique(hashes, return_counts=True)
                    sides = [_shingles(x).view(np.int64) for x in question_and_answer(text)]
                    out.append((item, len(hashes), term.view(np.int64), tf, *sides))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return benchmark.select("item_id", "text").transform(map_batches, rows, ITEM)


@dataclass
class Index:
    """One part of the inverted index.

    Level 0 is the postings: term, item (its number in the part) and impact, by term and
    item; each level above has the largest impact of a term in a block of FANOUT numbers of
    the level below, up to one with FANOUT blocks at most.  children: where an entry's
    entries of the level below begin.
    """

    items: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    half: int
    terms: np.ndarray
    largest: np.ndarray
    term: list[np.ndarray]
    number: list[np.ndarray]
    impact: list[np.ndarray]
    children: list[np.ndarray]
    question: tuple[np.ndarray, np.ndarray]
    answer: tuple[np.ndarray, np.ndarray]

    def width(self, level: int) -> int:
        """Numbers of a level."""
        return (len(self.items) - 1) // FANOUT**level + 1


def _levels(term: np.ndarray, item: np.ndarray, impact: np.ndarray, items: int) -> tuple[list[np.ndarray], ...]:
    terms, numbers, impacts, children = [term], [item], [impact], [np.zeros(0, np.int64)]
    while (items - 1) // FANOUT ** (len(terms) - 1) + 1 > FANOUT or len(terms) == 1:
        block = numbers[-1] // FANOUT
        begin = np.flatnonzero((np.diff(terms[-1], prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        children.append(np.append(begin, len(block)))
        impacts.append(np.maximum.reduceat(impacts[-1], begin))
        numbers.append(block[begin])
        terms.append(terms[-1][begin])
    return terms, numbers, impacts, children


def indexes(benchmark: DataFrame, retrieve: float = RETRIEVE, part_postings: int = PART_POSTINGS) -> Iterator[Index]:
    """The parts of the index of all items, one after the other."""
    # numbered by length: blocks hold items of like length, which makes their maxima tight
    ordered = _parsed(benchmark).orderBy("length", "item_id", "terms")
    items = staged(ordered.withColumn("number", F.monotonically_increasing_id()), "leak-items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    if not size["n"]:
        return
    postings = items.select("number", "length", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("number", "length", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("length") / size["mean"])
    weighed = staged(postings.join(df, "term").select("number", "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("impact")), "leak-postings")
    own = weighed.groupBy("number").agg((retrieve * F.sum("impact")).alias("threshold"))
    # running sums of postings: within runs of numbers, and over the runs before
    n = F.size("terms")
    run = F.shiftright("number", 10)
    runs = items.groupBy(run.alias("run")).agg(F.sum(n).alias("n"))
    ahead = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("ahead"))
    within = F.sum(n).over(Window.partitionBy("run").orderBy("number")) - n
    placed = items.withColumn("run", run).withColumn("within", within).join(ahead, "run")
    placed = placed.withColumn("part", F.floor((F.col("ahead") + F.col("within")) / part_postings).cast("int")).drop("run", "within", "ahead")
    placed = staged(placed.join(own, "number"), "leak-parts")
    for r in placed.select("part").distinct().orderBy("part").collect():
        part = placed.where(F.col("part") == r["part"])
        yield _part(part, weighed.join(part.select("number"), "number", "left_semi"), max(HALF, size["longest"]))


def _part(items: DataFrame, postings: DataFrame, half: int) -> Index:
    """The arrays of one part, whose rows Spark has bounded."""
    rows = items.select("number", "item_id", "length", "threshold", "question", "answer").toArrow().sort_by("number").combine_chunks()
    number, threshold = (rows[c].to_numpy() for c in ("number", "threshold"))
    found = postings.toArrow()
    term, impact = found["term"].to_numpy().view(np.uint64), found["impact"].to_numpy()
    item = np.searchsorted(number, found["number"].to_numpy())
    terms, at = np.unique(term, return_inverse=True)
    order = np.lexsort((item, at))
    term, item, impact = at[order].astype(np.int32), item[order].astype(np.int32), (impact / threshold[item])[order]
    levels = _levels(term, item, impact, len(number))
    largest = np.maximum.reduceat(impact, np.flatnonzero(np.diff(term, prepend=-1)))
    sides = []
    for side in ("question", "answer"):
        lists = rows[side].combine_chunks()
        sides.append((np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()))
    items_ = rows["item_id"].to_numpy(zero_copy_only=False) if not rows["item_id"].null_count else np.array(rows["item_id"].to_pylist(), dtype=object)
    return Index(items_, threshold, rows["length"].to_numpy(), half, terms, largest, *levels, *sides)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def retrieve_items(index: Index, holder: np.ndarray, term: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all items that a passage retrieves; the score is the BM25 sum.

    holder and term are the distinct terms of each half passage, by half; passage p is half
    p and, where it follows, half p + 1.
    """
    halves, none = len(follows), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    bound = np.append(np.bincount(holder, index.largest[term], minlength=halves), 0.0)
    alive = bound[:-1] + bound[1:] * follows >= 1 - _ROUNDING
    if not alive.any():
        return none
    # entries of the top level, for halves of passages that are still in question
    top = len(index.term) - 1
    width = index.width(top)
    wanted = alive | np.append(False, (alive & follows)[:-1])
    holder_, term_ = holder[wanted[holder]], term[wanted[holder]]
    edges = np.searchsorted(index.term[top], np.arange(len(index.terms) + 1))
    count = edges[term_ + 1] - edges[term_]
    at = _ranges(edges[term_], count)
    key = np.repeat(holder_, count) * width + index.number[top][at]
    sums = np.concatenate([np.bincount(key, index.impact[top][at], minlength=halves * width).reshape(halves, width), np.zeros((1, width))])
    passage, number = np.nonzero((sums[:-1] + sums[1:] * follows[:, None] >= 1 - _ROUNDING) & alive[:, None])
    if not len(passage):
        return none
    # the distinct terms of each passage that is left, and their entries in its blocks
    first = np.searchsorted(holder, np.arange(halves + 2))
    distinct = np.unique(passage)
    ends = first[distinct + 1 + follows[distinct]]
    pairs = np.repeat(distinct, ends - first[distinct]), term[_ranges(first[distinct], ends - first[distinct])]
    pairs = np.unique(pairs[0] * len(index.terms) + pairs[1])
    own, term = pairs // len(index.terms), pairs % len(index.terms)
    begin, count = np.searchsorted(own, passage), np.searchsorted(own, passage, side="right") - np.searchsorted(own, passage)
    which = np.repeat(np.arange(len(passage)), count)
    asked = term[_ranges(begin, count)].astype(np.int64) * width + number[which]
    keys = index.term[top].astype(np.int64) * width + index.number[top]
    entry = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[entry] == asked
    entry, which = entry[hit], passage[which[hit]]
    for level in range(top - 1, -1, -1):
        child = index.children[level + 1]
        count = child[entry + 1] - child[entry]
        which, entry = np.repeat(which, count), _ranges(child[entry], count)
        key = which * index.width(level) + index.number[level][entry]
        nodes, at = np.unique(key, return_inverse=True)
        sums = np.bincount(at, index.impact[level][entry])
        keep = (sums >= 1 - _ROUNDING)[at]
        which, entry = which[keep], entry[keep]
    nodes, sums = nodes[sums >= 1 - _ROUNDING], sums[sums >= 1 - _ROUNDING]
    passage, item = nodes // len(index.items), nodes % len(index.items)
    return passage, item, sums * index.threshold[item]


def search(index: Index, data: np.ndarray, offsets: np.ndarray, question: float, answer: float) -> list[tuple]:
    """(row, item, score, question share, answer share, first word, words) of the leaks in rows laid end to end."""
    w = W.split(data, offsets, lower=True, between=W.MARKS)
    hashes, first, half = w.hashes(), w.first(), index.half
    if not len(hashes):
        return []
    # halves of passages, numbered over all rows; a row has one at least if it has words
    count = -(-np.diff(first) // half)
    begin_of = np.concatenate([[0], np.cumsum(count)])
    chunk = begin_of[w.row] + (np.arange(len(hashes)) - first[w.row]) // half
    chunk_row = np.repeat(np.arange(len(count)), count)
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = index.terms[at] == hashes
    size = len(index.terms)
    pairs = np.unique(chunk[hit] * size + at[hit])
    follows = np.append(chunk_row[1:] == chunk_row[:-1], False)
    best: dict[tuple[int, int], tuple] = {}
    for p, i, score in zip(*(x.tolist() for x in retrieve_items(index, pairs // size, pairs % size, follows)), strict=True):
        row = int(chunk_row[p])
        start = first[row] + (p - begin_of[row]) * half
        lo, hi = max(first[row], start - index.length[i]), min(first[row + 1], start + 2 * half + index.length[i])
        q, a = (_share(values[ends[i] : ends[i + 1]], hashes[lo:hi]) for values, ends in (index.question, index.answer))
        found = (score, q, a, int(start - first[row]), int(min(2 * half, first[row + 1] - start)))
        if q >= question and a >= answer and found > best.get((row, i), ()):
            best[row, i] = found
    return [(row, index.items[i], *found) for (row, i), found in sorted(best.items())]


def _share(shingles: np.ndarray, hashes: np.ndarray) -> float:
    """Share of shingles that stand in a run of words; an empty side is found."""
    if not len(shingles):
        return 1.0
    sizes = {min(SHINGLE, n) for n in range(1, SHINGLE + 1)} if len(shingles) == 1 else {SHINGLE}
    there = np.concatenate([W.grams(hashes, k) for k in sizes])
    return float(np.isin(shingles, there).mean())


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, passage_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, *, question: float = QUESTION, answer: float = ANSWER, retrieve: float = RETRIEVE, part_postings: int = PART_POSTINGS) -> DataFrame:
    """One row for each document and test item that it leaks, with the best passage.

    Whole texts are searched, where they are read; nothing is shuffled.  Null, empty and
    wordless texts and items have no leaks.  Repeated rows of docs give repeated rows;
    repeated items are items of their own; a null doc_id or item_id stays null.  Of
    passages with equal scores the one with the larger overlaps, then the later, is told.
    No items or no documents: no rows.  Words of a passage are runs of letters and digits;
    first_word counts them from 0.  Other columns are ignored.
    """
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for index in indexes(benchmark, retrieve, part_postings):
        found = found.unionByName(_leaks(docs, index, question, answer))
    return found


def _leaks(docs: DataFrame, index: Index, question: float, answer: float) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(index)
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in LEAKS.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in W.slices(batch.column("text")):
                found = search(sent.value, data, offsets, question, answer)
                if found:
                    columns = list(zip(*found, strict=True))
                    ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([a + r for r in columns[0]]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").transform(map_batches, rows, LEAKS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, question: float = QUESTION, answer: float = ANSWER, retrieve: float = RETRIEVE) -> DataFrame:
    """The rows of docs that leak no item, with all their columns, whatever their names.

    Rows are judged where they are read, so no document is shuffled.  Null and empty texts
    stay, repeated rows stay or go together, and without items all rows stay.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    for index in indexes(benchmark, retrieve):
        docs = docs.where(~_leaky(spark.sparkContext.broadcast(index), question, answer)("text"))
    return docs


def _leaky(sent: Broadcast, question: float, answer: float):
    """A function of texts that tells whether they leak an item of the index."""

    @F.arrow_udf("boolean")
    def leaky(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), dtype=bool)
        for a, _, data, offsets in W.slices(text):
            out[[a + found[0] for found in search(sent.value, data, offsets, question, answer)]] = True
        return pa.array(out)

    return leaky
