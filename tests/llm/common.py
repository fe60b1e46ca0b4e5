"""Documents with every awkward case, and the words of a text."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, place string, comp int, shard int, row long, fp string, n_words int"


def words(text):
    return SPACE.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(f"word{i % 5000}x{i // 5000}" for i in range(60_000))
    line = " ".join(f"alpha{i}" for i in range(60))
    rows = [
        (1, line, "en", "a"),
        (2, line, "en", "a"),
        (3, None, None, None),
        (4, "", "fr", ""),
        (5, "   \n\t ", None, "a"),
        (6, long_text, "en", "b"),
        (7, line + " beta gamma", "de", "b"),
        (7, line + " beta gamma", "de", "b"),
        (None, "a text without an id", "en", None),
        (None, None, None, None),
        (9, "été Ünïcode   nbsp word 日本語 \U0001f600", "fr", "b"),
        (10, "Licensed under the Apache License, Version 2.0.\nx", "en", "c"),
    ]
    full = [(i, t, la, s, len(t) if t is not None else None, 1, "p", 2, 3, 4, "f", 5) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
