"""Quality rules: text statistics and a learned decision list.

The list is learned by sequential covering on a bounded sample of labelled documents: a
conjunction of thresholds is grown on a growing set, pruned on a pruning set, and kept
while it is right often enough; the rows it covers are then set aside.  The rules become
one ordered Spark conditional expression, so applying them is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm import words as W
from textmill.llm.runtime import bound_batches

#: Labelled rows that the list is learned from at most, taken by a hash of doc_id.
SAMPLE_ROWS = 20_000
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs", "n_digits")
#: What the rules look at; all are shares or means, so the rules do not depend on length alone.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_KINDS = {
    "n_symbols": _SYMBOL,
    "n_bangs": np.arange(256) == ord("!"),
    "n_digits": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "n_upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    # every byte that starts a character beyond ASCII counts as a letter
    "n_letters": (np.arange(256) >= 192) | ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122) & (np.arange(256) < 128),
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(w: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each row, and those equal to an earlier line of the row."""
    data, rows = w.data, w.rows
    if not len(w.starts):
        return np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    breaks = data == 10
    begin = np.unique(np.concatenate([w.offsets[:-1], np.flatnonzero(breaks) + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    row = np.searchsorted(w.offsets, begin, side="right") - 1
    # a line ends before its \\n, or with its row
    end = np.where(breaks[end - 1], end - 1, end)
    first = np.searchsorted(w.starts, begin, side="left")
    full = (first < len(w.starts)) & (np.append(w.starts, len(data) + 1)[first] < end)
    begin, end, row = begin[full], end[full], row[full]
    whole = W.Words(data, w.offsets, begin, end, row)
    key = np.stack([row.astype(np.uint64), whole.hashes(), (end - begin).astype(np.uint64)], axis=1)
    lines = np.bincount(row, minlength=rows)
    if not len(key):
        return lines, lines
    kept = np.unique(key, axis=0)
    return lines, lines - np.bincount(kept[:, 0].astype(np.int64), minlength=rows)


def _repeat_words(w: W.Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Words of each row in windows found twice or more in it."""
    out = np.zeros(w.rows, dtype=np.int64)
    g = W.grams(hashes, window)
    if not len(g):
        return out
    at = np.flatnonzero(w.row[: len(g)] == w.row[window - 1 :])
    key, row = g[at] ^ W.mix(w.row[at].astype(np.uint64)), w.row[at]
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(w.row[covered], minlength=w.rows).astype(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """COUNTS of each row."""
    w = W.split(data, offsets)
    hashes = w.hashes()
    out = {k: _per_row(flag[data], offsets) for k, flag in _KINDS.items()}
    out["n_words"] = np.bincount(w.row, minlength=w.rows)
    inside = ~W._SPACE[data] & ((data & 0xC0) != 0x80)
    out["word_chars"] = _per_row(inside, offsets)
    out["n_lines"], out["n_dup_lines"] = _dup_lines(w, hashes)
    out["n_repeat_words"] = _repeat_words(w, hashes, window)
    return {k: out[k].astype(np.int64) for k in COUNTS}


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counted(text: pa.Array) -> pa.Array:
    parts = [measure(data, offsets) for _, _, data, offsets in W.slices(text)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in COUNTS], list(COUNTS))


def statistics(docs: DataFrame, name: str = "stats") -> DataFrame:
    """docs with a struct of COUNTS of every row's whole text; nothing is shuffled.

    A null text has no words.  A text's lines are what stands between its ``\\n``; a line
    counts if it has a word.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(name, _counted("text"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, at least?, threshold); rows that meet all are rejected."""

    terms: tuple[tuple[str, bool, float], ...]

    def matches(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for name, least, cut in self.terms:
            v = x[:, names.index(name)]
            ok &= v >= cut if least else v <= cut
        return ok

    def column(self) -> Column:
        ok = F.lit(True)
        for name, least, cut in self.terms:
            v = F.expr(FEATURES[name])
            ok = ok & ((v >= F.lit(cut)) if least else (v <= F.lit(cut)))
        return ok


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], max_terms: int, cuts: int) -> Rule:
    """Add the term of most information gain until no bad row's neighbour is good or nothing helps."""
    terms: list[tuple[str, bool, float]] = []
    on = np.ones(len(y), dtype=bool)
    while len(terms) < max_terms and (y[on] == 0).any():
        pos, neg = y[on].sum(), (~y[on].astype(bool)).sum()
        best = (1e-9, None)
        for j, name in enumerate(names):
            v = x[on, j]
            # midpoints between neighbouring values, so that a threshold is no row's own value
            values = np.unique(v)
            middles = (values[1:] + values[:-1]) / 2
            if len(middles) > cuts:
                middles = middles[np.linspace(0, len(middles) - 1, cuts).astype(int)]
            if not len(middles):
                continue
            order = np.argsort(v, kind="stable")
            ys = np.concatenate([[0], np.cumsum(y[on][order])])
            below = np.searchsorted(v[order], middles, side="right")
            for least in (True, False):
                p = pos - ys[below] if least else ys[below]
                n = (len(v) - below if least else below) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(pos / (pos + neg))), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, least, float(middles[k])))
        if best[1] is None:
            break
        terms.append(best[1])
        on &= Rule((best[1],)).matches(x, names)
    return Rule(tuple(terms))


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> float:
    m = rule.matches(x, names)
    p, n = y[m].sum(), (1 - y[m]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], *, precision: float = 0.9, least_rows: int = 3, max_rules: int = 12, max_terms: int = 3, cuts: int = 64) -> list[Rule]:
    """An ordered list of rules that reject bad rows.

    A third of the rows prunes what the others grow.  A rule is kept if, over all rows not
    yet covered, it rejects at least least_rows bad rows and at least `precision` of what
    it rejects is bad.  No bad rows, or no rows: no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    prune_set = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules and bad[left].any():
        grow, prune = left & ~prune_set, left & prune_set
        rule = _grow(x[grow], bad[grow].astype(int), names, max_terms, cuts)
        while len(rule.terms) > 1 and _worth(Rule(rule.terms[:-1]), x[prune], bad[prune].astype(int), names) >= _worth(rule, x[prune], bad[prune].astype(int), names):
            rule = Rule(rule.terms[:-1])
        covered = rule.matches(x, names) & left
        if not rule.terms or bad[covered].sum() < least_rows or bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """1-based number of the first rule that rejects the row, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_from(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from the texts of labelled documents (quality 0 is bad): sample_rows labels at most.

    The labels are taken by a hash of their doc_id, so only sampled texts are measured.
    Rows without a label or with a null one are left out; a doc_id with several labels
    counts once for each.  No labels: no rules, and every document passes them.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    # sample_rows rows of 12 bytes at most, so they can go to every executor
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "quality").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    picked = (
        statistics(texts, "__stats")
        .select("doc_id", "quality", "__stats.*")
        .select("doc_id", "quality", *(F.expr(e).alias(k) for k, e in FEATURES.items()))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "quality")
        .toPandas()
    )
    names = list(FEATURES)
    return learn(picked[names].to_numpy(dtype=float), (picked["quality"] == 0).to_numpy(), names)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (number of the rule that rejected the row) and kept, for every row of docs.

    Null and empty texts have no words and fail the base rule.  Repeated rows are judged
    one by one.  An empty table gives an empty result.
    """
    rules = learn_from(docs, labels, sample_rows=sample_rows)
    counted = statistics(docs.select("doc_id", "text"), "__stats").select("doc_id", "__stats.*")
    judged = counted.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_documents(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; rows are judged where they are read."""
    rules = learn_from(docs, labels, sample_rows=sample_rows)
    # the struct alone, so that no column of docs clashes with a count's name
    named = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text"), "__stats")
    return named.select("__row", "__stats.*").where(~base_failed() & (verdict(rules) == 0)).select("__row.*")
