"""Decontamination against brute-force BM25 over every passage and item."""

import math
import re
from collections import Counter

import pytest

from textmill.llm import decontamination as D

_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def _words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in _WORD.findall(text or "")]


def _grams(words, k=5):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_force(docs, items):
    own = [(i, _words(t), t) for i, t in items if _words(t)]
    mean = sum(len(w) for _, w, _ in own) / len(own)
    df = Counter(x for _, w, _ in own for x in set(w))
    half = max(D.HALF, max(len(w) for _, w, _ in own))

    def impact(word, words):
        tf = words[word]
        n = sum(words.values())
        return math.log(1 + (len(own) - df[word] + 0.5) / (df[word] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))

    counts = [(i, Counter(w), [_grams(_words(x)) for x in D.question_and_answer(t)]) for i, w, t in own]
    weights = [{x: impact(x, c) for x in c} for _, c, _ in counts]
    found = {}
    for d, text in docs:
        w = _words(text)
        for start in range(0, len(w), half):
            passage = set(w[start : start + 2 * half])
            for (i, c, sides), weight in zip(counts, weights, strict=True):
                score = sum(v for x, v in weight.items() if x in passage)
                if score >= 0.5 * sum(weight.values()) * (1 - 1e-12):
                    n = sum(c.values())
                    near = w[max(0, start - n) : start + 2 * half + n]
                    shares = [len({g for g in s if g in _near(near, s)}) / len(s) if s else 1.0 for s in sides]
                    if min(shares) >= 0.5:
                        found[d, i] = max(found.get((d, i), 0.0), score)
    return found


def _near(words, side):
    k = len(next(iter(side)))
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}


def _compared(spark, docs, items, **options):
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    assert len(got) == len(rows)
    want = brute_force(docs, items)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    return got


def test_leaks_are_those_of_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    whole = _compared(spark, docs, items)
    assert whole
    # the number of parts changes nothing
    assert _compared(spark, docs, items, part_postings=200).keys() == whole.keys()


def test_many_blocks_of_items(spark):
    import random

    rng = random.Random(2)
    items = [(k, " ".join(f"t{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(3, 40))) + ". answer here.") for k in range(300)]
    docs = [(k, " ".join([*(f"t{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(200))), items[rng.randrange(300)][1] if k % 2 else ""])) for k in range(60)]
    assert _compared(spark, docs, [*items, (None, ""), (301, None), (302, "...")])
