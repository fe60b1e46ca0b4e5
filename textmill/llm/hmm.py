"""A hidden Markov language model over words.

Words that are frequent are symbols of their own; all others share a symbol with the
words of like ending, and inside a symbol a word has its add-one share of the symbol's
counts, with one share for every word not seen.  Latent states emit symbols.  Baum-Welch
runs over whole texts: expectations are added up inside each task, then over tasks by a
Spark aggregate; the model (symbols x states) has a fixed size.  The first rounds read a
fixed share of the training documents, the last ones all of them.  Texts are scored by the
scaled forward recursion over their whole token sequence.

Long texts are worked on in runs of RUN tokens side by side, without any cut: the product
of a run's transition and emission matrices leads from its first state to the next run's,
so every run starts with the forward (and ends with the backward) vector of the whole text.

Word counts cover the whole training corpus and stay in a table.  Only the most frequent
ones, up to a fixed number, are sent to tasks; what a text's other words count is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import words as W
from textmill.llm.runtime import map_batches, staged

STATES = 8
#: Symbols shared by words of like ending.
ENDINGS = 1024
#: Words with a symbol of their own, the most frequent ones.
OWN_SYMBOLS = 8_192
#: Words whose counts are sent to tasks at most (16 bytes each).
SENT_WORDS = 1 << 19
#: Tokens of a long text that are worked on in a row; bytes of text that are worked on side by side.
RUN, SIDE_BY_SIDE = 1024, 4 << 20
#: Tokens whose forward-backward is worked on side by side, and steps after which products are scaled.
TOKENS, SCALED = 600_000, 16
#: The share of training documents that the first rounds read, their number at most, and rounds over all documents.
SHARE, SHARE_ROUNDS, ROUNDS = 16, 12, 3
#: The first rounds end when the log likelihood gains less than this part of itself.
GAIN = 5e-4
END_KEY = np.uint64(0)
_LOW = np.uint64(ENDINGS - 1)


def endings_of(w: W.Words) -> np.ndarray:
    """The number of each word's ending (last three bytes)."""
    length = w.ends - w.starts
    ending = w.data[w.ends - 1].astype(np.uint64)
    for back in (2, 3):
        ending |= np.where(length >= back, w.data[np.maximum(w.ends - back, 0)], 0).astype(np.uint64) << np.uint64(8 * (back - 1))
    return (W.mix(ending) & _LOW).astype(np.int32)


def tokens(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, keys, endings, first token of each row and the end) of runs of rows; each row is closed by the end token."""
    for a, b, w in W.batches(text, lower=True, limit=SIDE_BY_SIDE):
        first = np.concatenate([[0], np.cumsum(np.bincount(w.row, minlength=b - a) + 1)])
        keys, endings = np.full(first[-1], END_KEY, dtype=np.uint64), np.zeros(first[-1], dtype=np.int32)
        at = np.arange(len(w.row)) + w.row
        # the end's key is no word's
        keys[at], endings[at] = np.maximum(w.hashes(), END_KEY + np.uint64(1)), endings_of(w)
        yield a, b, keys, endings, first


def word_counts(docs: DataFrame) -> DataFrame:
    """k (key), g (ending) and c (count) of every token of docs; counts are combined in tasks before the shuffle."""
    schema = pa.schema([("k", pa.int64()), ("g", pa.int32()), ("c", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            k, at, c = np.unique(np.concatenate([k for k, _ in held]), return_index=True, return_counts=True)
            g = np.concatenate([g for _, g in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(g), pa.array(c.astype(np.int64))], schema=schema)

        for batch in batches:
            for _, _, keys, endings, _ in tokens(batch.column("text")):
                held.append((keys, endings))
                size += len(keys)
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("text").transform(map_batches, rows, "k long, g int, c long").groupBy("k").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Model:
    """Vocabulary and parameters; sums and normalisers are in log10."""

    total: int
    distinct: int
    sent: np.ndarray
    sent_log: np.ndarray
    symbol_of: np.ndarray
    ending_log: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def look_up(self, keys: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, log10(c + 1), and whether the key is among the words sent; others have the symbol of their ending and 0."""
        symbols, logs = endings, np.zeros(len(keys))
        if not len(self.sent):
            return symbols, logs, np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.sent, keys), len(self.sent) - 1)
        known = self.sent[at] == keys
        return np.where(known, self.symbol_of[at], symbols), np.where(known, self.sent_log[at], 0.0), known


def vocabulary(counts: DataFrame) -> tuple[Model, int]:
    """The model before training, and the count from which words are sent."""
    level = F.floor(8 * F.log2("c")).cast("int")
    # a few hundred levels at most, whatever the corpus
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    total, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    least, room = 1 << 62, SENT_WORDS
    for r in levels:
        room -= r["n"]
        if room < 0:
            break
        least = int(np.ceil(2 ** (r["level"] / 8) - 1e-9))
    # as Arrow columns: rows of Python objects would be many times as large
    frequent = counts.where(F.col("c") >= least).toArrow()
    key, c = frequent["k"].to_numpy().view(np.uint64), frequent["c"].to_numpy()
    order = np.argsort(key)
    key, c = key[order], c[order]
    own = np.lexsort((key, -c))[:OWN_SYMBOLS]
    ending = frequent["g"].to_numpy()[order]
    symbol = ending.copy()
    symbol[own] = ENDINGS + np.arange(len(own), dtype=np.int32)
    by_ending = np.zeros(ENDINGS)
    tokens_of = np.zeros(ENDINGS + OWN_SYMBOLS)
    for r in counts.groupBy("g").agg(F.sum(F.col("c") + 1).alias("s"), F.sum("c").alias("c")).collect():
        by_ending[r["g"]], tokens_of[r["g"]] = r["s"], r["c"]
    np.subtract.at(by_ending, ending[own], c[own] + 1)
    np.subtract.at(tokens_of, ending[own], c[own])
    tokens_of[ENDINGS : ENDINGS + len(own)] = c[own]
    weight = (tokens_of + 1) / (total + len(tokens_of))
    k = STATES
    flat = np.full(k, 1 / k)
    return Model(total, distinct, key, np.log10(c + 1.0), symbol, np.log10(by_ending + 1), weight, flat, np.eye(k), np.repeat(weight[:, None], k, axis=1)), least


@dataclass
class Expected:
    """Expected counts of a pass and the log10 likelihood of its texts."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    likelihood: float


@dataclass
class Runs:
    """The runs of some texts, by falling length: their first token and length, the text of each, whether it opens the text, and the run that follows it (-1: none)."""

    symbols: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    text: np.ndarray
    opens: np.ndarray
    next: np.ndarray

    @property
    def longest(self) -> int:
        return int(self.length.max(initial=0))

    def at(self, t: int) -> np.ndarray:
        """The symbols at place t of the runs that reach it, which are the first ones."""
        return self.symbols[self.begin[: int(np.searchsorted(-self.length, -t, side="left"))] + t]


def runs_of(symbols: np.ndarray, first: np.ndarray) -> Runs:
    length = np.diff(first)
    count = -(-length // RUN)
    text = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(RUN, length[text] - RUN * number)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    after = np.append(place[1:], -1)[: len(order)]
    after[number == count[text] - 1] = -1
    return Runs(symbols, (first[:-1][text] + RUN * number)[order], size[order], text[order], number[order] == 0, after[order])


def _entries(model: Model, runs: Runs, backward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: the state distribution with which it begins (before its first token), the backward vector at its end, and log10 of the scale that the former lacks.

    Only the runs of texts that have several are multiplied out; they are led along the
    texts, all texts at once.
    """
    n, k = len(runs.length), len(model.start)
    begin = np.repeat(model.start[None].astype(np.float64), n, axis=0)
    end = np.ones((n, k))
    # the forward way leads through all runs but a text's last, the backward way through all but its first
    several = np.flatnonzero((runs.next >= 0) | (~runs.opens & backward))
    if not len(several):
        return begin, end, several
    product = np.repeat(np.eye(k)[None], len(several), axis=0)
    for t in range(runs.longest):
        now = runs.at(t)
        active = int(np.searchsorted(several, len(now)))
        if not active:
            break
        if t:
            product[:active] = (product[:active].reshape(-1, k) @ model.move).reshape(-1, k, k)
        product[:active] *= model.emit.take(now[several[:active]], axis=0)[:, None]
        if t % SCALED == SCALED - 1:
            product[:active] /= product[:active].sum(axis=(1, 2), keepdims=True)
    product /= product.sum(axis=(1, 2), keepdims=True)
    place = np.full(n, -1)
    place[several] = np.arange(len(several))
    here = several[runs.opens[several]]
    chain = [here]
    while len(here):
        ahead = runs.next[here]
        here, ahead = here[ahead >= 0], ahead[ahead >= 0]
        if len(here):
            state = np.einsum("ni,nij->nj", begin[here], product[place[here]])
            begin[ahead] = (state / state.sum(axis=1, keepdims=True)) @ model.move
            chain.append(ahead)
        here = ahead
    if backward:
        for now in reversed(chain[:-1]):
            now = now[runs.next[now] >= 0]
            ahead = runs.next[now]
            back = np.einsum("nij,nj->ni", product[place[ahead]], end[ahead]) @ model.move.T
            end[now] = back / back.sum(axis=1, keepdims=True)
    return begin, end, several


def expect(model: Model, symbols: np.ndarray, first: np.ndarray) -> Expected:
    """Forward-backward over whole texts, laid end to end."""
    runs, k, move = runs_of(symbols, first), len(model.start), model.move
    emit, moved, likelihood = np.zeros((len(model.weight), k)), np.zeros((k, k)), 0.0
    if not len(runs.length):
        return Expected(emit, moved, np.zeros(k), likelihood)
    begin, end, _ = _entries(model, runs, True)
    # states are scaled to a sum of 1 at every token, so single precision holds them; counts and logarithms are summed in double
    emission, move, begin, back = (x.astype(np.float32) for x in (model.emit, move, begin, end))
    # row sums as products: numpy's own over a short last axis are several times slower
    ones = np.ones(k, dtype=np.float32)
    # kept by place: as many rows as there are tokens, whatever the lengths
    alpha, state = [], begin
    for t in range(runs.longest):
        now = runs.at(t)
        # a new array, as begin is read again below
        state = (state if t == 0 else state[: len(now)] @ move) * emission.take(now, axis=0)
        scale = state @ ones
        likelihood += float(np.log10(scale).sum(dtype=float))
        state /= scale[:, None]
        alpha.append(state)
    # moves between runs that follow each other; only full runs are followed
    joined = np.flatnonzero(runs.next >= 0)
    last = alpha[RUN - 1][joined] if len(joined) else None
    for t in range(runs.longest - 1, -1, -1):
        now = runs.at(t)
        m = len(now)
        ahead = emission.take(now, axis=0) * back[:m] if t else None
        gamma = alpha[t]
        gamma *= back[:m]
        gamma /= (gamma @ ones)[:, None]
        if t:
            led = ahead @ move.T
            before = alpha[t - 1][:m]
            # the chance of this token with all that follows, given what was before it
            weight = ((before * led) @ ones)[:, None]
            moved += before.T @ (ahead / weight)
            back[:m] = led / weight
    if len(joined):
        ahead = runs.next[joined]
        moved += last.T @ (alpha[0][ahead] / np.maximum(begin[ahead], np.float32(1e-37)))
    at = np.concatenate([runs.at(t) for t in range(runs.longest)])
    for s in range(k):
        emit[:, s] = np.bincount(at, weights=np.concatenate([g[:, s] for g in alpha]), minlength=len(emit))
    return Expected(emit, moved * move, alpha[0][runs.opens].sum(axis=0, dtype=float), likelihood)


def improve(model: Model, e: Expected) -> Model:
    """Parameters from expected counts; every symbol keeps a share of its overall weight in every state."""
    k = len(model.start)

    def share(x: np.ndarray, add: np.ndarray | float) -> np.ndarray:
        x = x + add
        return x / x.sum(axis=0)

    emit = share(e.emit, 20.0 * model.weight[:, None])
    move = share(e.move.T, 1.0).T
    return Model(**{**model.__dict__, "emit": emit, "move": move, "start": share(e.start, 1 / k)})


def first_model(model: Model, *, seed: int = 5) -> Model:
    """Random emissions and sticky states."""
    random = np.random.default_rng(seed)
    emit = model.weight[:, None] * random.lognormal(0, 0.7, (len(model.weight), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(**{**model.__dict__, "emit": emit / emit.sum(axis=0), "move": move})


def symbols_of(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the symbols of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("symbols", pa.list_(pa.int16()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, keys, endings, first in tokens(batch.column("text")):
                found = sent.value.look_up(keys, endings)[0].astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), lists], schema=schema)

    return docs.select("doc_id", "text").transform(map_batches, rows, "doc_id long, symbols array<short>")


def _blocks(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and first tokens of runs of rows of about TOKENS tokens; a longer row is one of its own."""
    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)
    a = 0
    while a < len(lists):
        b = min(len(lists), max(a + 1, int(np.searchsorted(ends, ends[a] + TOKENS, side="right")) - 1))
        yield flat[ends[a] : ends[b]], ends[a : b + 1].astype(np.int64) - ends[a]
        a = b


def baum_welch_round(model: Model, texts: DataFrame) -> tuple[Model, float]:
    """A round over all texts (symbols), and the log10 likelihood before it; each task sends one row for a symbol, and Spark adds them up."""
    spark, k, size = texts.sparkSession, len(model.start), len(model.weight)
    schema = pa.schema([("symbol", pa.int32()), *((f"s{i}", pa.float64()) for i in range(k))])
    sent = spark.sparkContext.broadcast(Model(0, 0, *[np.zeros(0)] * 4, model.weight, model.start, model.move, model.emit))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, np.zeros((size + k + 2, k))
        for batch in batches:
            for symbols, first in _blocks(batch.column("symbols")):
                e = expect(own, symbols, first)
                total[:size] += e.emit
                total[size : size + k] += e.move
                total[-2] += e.start
                total[-1, 0] += e.likelihood
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, i]) for i in range(k))], schema=schema)

    names = [f"s{i}" for i in range(k)]
    added = texts.select("symbols").transform(map_batches, rows, "symbol int, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    sent.unpersist()
    total = np.zeros((size + k + 2, k))
    total[added["symbol"].to_numpy()] = np.stack([added[n].to_numpy() for n in names], axis=1)
    return improve(model, Expected(total[:size], total[size : size + k], total[-2], total[-1, 0])), float(total[-1, 0])


def baum_welch(model: Model, docs: DataFrame, *, rounds: int = ROUNDS) -> Model:
    """Rounds over a fixed share of docs until the likelihood hardly grows, then over all of docs.

    Texts are turned into symbols once, and these are written.
    """
    texts = staged(symbols_of(docs, model), "hmm-symbols")
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARE)) == 0)
    before = -np.inf
    for _ in range(SHARE_ROUNDS):
        model, likelihood = baum_welch_round(model, some)
        if likelihood == 0 or likelihood - before < GAIN * abs(likelihood):
            break
        before = likelihood
    for _ in range(rounds):
        model, _ = baum_welch_round(model, texts)
    return model


def forward(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol sequence: the forward recursion, scaled at every token, over all runs at once."""
    runs = runs_of(symbols, first)
    begin, _, _ = _entries(model, runs, False)
    out = np.zeros(len(runs.length))
    state, ones = begin, np.ones(len(model.start))
    for t in range(runs.longest):
        now = runs.at(t)
        state = (state if t == 0 else state[: len(now)] @ model.move) * model.emit.take(now, axis=0)
        scale = state @ ones
        out[: len(now)] += np.log10(scale)
        state = state / scale[:, None]
    return np.bincount(runs.text, out, minlength=len(first) - 1)


def score(docs: DataFrame, model: Model, counts: DataFrame, least: int) -> DataFrame:
    """Scores of every row of docs; docs needs doc_id, text and held_out.

    The forward recursion and the counts of words sent are local; the counts of a text's
    other words come by a join on the word.  Rows are numbered, so repeats of a doc_id are
    scored one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_sent", pa.int64()),
        ("base", pa.float64()), ("model", pa.float64()), ("others", pa.list_(pa.int64())),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = sent.value, TaskContext.get().partitionId() << 40
        shared = np.concatenate([own.ending_log, np.zeros(OWN_SYMBOLS)])
        for batch in batches:
            parts, ends, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
            for _, _, k, e, first in tokens(batch.column("text")):
                parts.append(k)
                ends.append(e)
                firsts.append(first[1:] + at)
                at += len(k)
            keys, first = np.concatenate(parts), np.concatenate(firsts)
            symbols, logs, known = own.look_up(keys, np.concatenate(ends))
            n = len(first) - 1

            def total(x: np.ndarray, first=first) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(x)])[first])

            model_sum = forward(own, symbols, first) + total(np.where(symbols < ENDINGS, logs - shared[symbols], 0.0))
            others = np.flatnonzero(~known)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(others, first), pa.int32()), pa.array(keys[others].view(np.int64)))
            columns = [number + np.arange(n), None, None, np.diff(first), total(known), total(logs), model_sum]
            arrays = [pa.array(c) if c is not None else batch.column(f.name).cast(f.type) for c, f in zip(columns, schema, strict=False)]
            arrays = [a.cast(f.type) for a, f in zip(arrays, schema, strict=False)]
            number += n
            yield pa.RecordBatch.from_arrays([*arrays, lists], schema=schema)

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_sent long, base double, model double, others array<long>"
    local = staged(docs.select("doc_id", "text", "held_out").transform(map_batches, rows, ddl), "hmm-scores")
    rest = counts.where(F.col("c") < least).drop("g")
    found = local.select("row", F.explode("others").alias("k")).join(rest, "k").groupBy("row").agg(F.count(F.lit(1)).alias("n_other"), F.sum(F.log10(F.col("c") + 1)).alias("other"))
    other = F.coalesce("other", F.lit(0.0))
    return local.drop("others").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_sent") + F.coalesce("n_other", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + other - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)))).alias("base_score"),
        (F.col("model") + other).alias("score"),
    )


def score_documents(docs: DataFrame, held_out: Column, *, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows of docs that are not held out, score all.

    Null and blank texts are one end token.  Repeated rows count and are scored as often
    as they stand.  With no training rows every word is unknown.  An empty table gives
    no rows.  base_score is the add-one unigram's, score the model's log10 probability.
    """
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    learnt = marked.where(~F.col("held_out"))
    counts = staged(word_counts(learnt), "hmm-counts")
    model, least = vocabulary(counts)
    model = baum_welch(first_model(model), learnt, rounds=rounds)
    return score(marked, model, counts, least)
