"""Attributes of a text that a prompt can name, the prompt, and the checks of what came back."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textmill.functions import hashing as H
from textmill.functions import text as T
from textmill.operators import dedup
from textmill.operators.tables import bound_batches

# Words, ends of sentences, list items and the like.
WORD = r"(?U)\b[a-zA-Z][a-zA-Z'-]+\b"
SENTENCE_ENDS = r"[.!?]+(?:\s|$)"
ITEM = r"\A([-*•]|\d+[.)])\s"
QUOTED = r"""\A["'-]"""
PREAMBLE = r"(?i)\A\s*(?:sure|certainly|of course|absolutely|here(?:'s| is)|below is|i'd be happy|as requested|great question|okay|ok)\b[^\n]{0,120}?[:\n]"
TRAILER = r"(?is)\n\s*(?:let me know if|i hope this helps|feel free to|would you like me to)\b.*$"
HEADING = r"\A\s*#{1,6}\s*\S[^\n]*(?:\n|\z)"
# Words that are no topics.
NO_TOPICS = (
    "the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was",
    "on", "be", "by", "this", "are", "from", "at", "or", "an", "have", "not", "but",
    "had", "has", "were", "which", "their", "they", "its", "been", "would", "there",
    "when", "into", "than", "then", "them", "these", "those", "such", "some", "other",
    "more", "most", "also", "over", "after", "before", "while", "during", "each",
    "about", "through", "between", "under", "against", "because", "however", "several",
    "being", "could", "should", "will", "may", "must", "very", "many", "much", "own",
)
# What tells genres and registers.
RESEARCH = ("we find", "this paper", "the results", "we show", "abstract")
NARRATIVE = ("i remember", "my father", "she said", "he said")
FORMAL = ("shall", "pursuant", "hereby", "the committee", "section")
CHATTY = ("you'll", "let's", "we've", "i think", "you can")
ANCHORS, TOPICS = 6, 3
# Tokens to a word, headroom over the length aimed at, least budget.
TOKENS_TO_A_WORD, HEADROOM, LEAST_BUDGET = 1.35, 1.3, 96


@dataclass(frozen=True)
class MirrorPolicy:
    """What a generated text may be against its source."""

    shortest: float = 0.6
    longest: float = 1.6
    most_alike: float = 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def structure(text: Column | str) -> Column:
    """listy, dialogue, sectioned or prose, by shares of the lines that are not blank."""
    lines = F.filter(F.transform(F.split(T._col(text), "\n"), T.strip), lambda line: line != "")

    def told(lines: Column) -> Column:
        share = lambda test: F.size(F.filter(lines, test)) / F.size(lines)
        return (
            F.when(F.size(lines) == 0, "prose")
            .when(share(lambda x: x.rlike(ITEM)) > 0.3, "listy")
            .when(share(lambda x: x.rlike(QUOTED) & (F.length(x) < 120)) > 0.4, "dialogue")
            .when((F.size(lines) > 4) & (share(lambda x: F.length(x) < 60) > 0.6), "sectioned")
            .otherwise("prose")
        )

    return T.bound(lines, told)


def difficulty(text: Column | str) -> Column:
    """plain, moderate or demanding, by words to a sentence and the share of long words; moderate without words."""
    t = T._col(text)

    def told(found: Column) -> Column:
        sentences = F.greatest(F.regexp_count(t, F.lit(SENTENCE_ENDS)), F.lit(1))
        score = F.size(found) / sentences / 20.0 + F.size(F.filter(found, lambda w: F.length(w) >= 8)) / F.size(found) / 0.15
        return F.when(F.size(found) == 0, "moderate").when(score < 1.0, "plain").when(score < 1.8, "moderate").otherwise("demanding")

    return T.bound(words(t), told)


def _names(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(phrases))


def genre(text: Column | str, structure: Column | str) -> Column:
    t, s = T._col(text), T._col(structure)
    by_phrase = F.when(_names(t, RESEARCH), "research-style summary").when(_names(t, NARRATIVE), "narrative piece").when(_names(t, FORMAL), "formal report")
    return F.when(s == "listy", "list-based guide").when(s == "dialogue", "dialogue").otherwise(by_phrase.otherwise("explainer"))


def register(text: Column | str, difficulty: Column | str) -> Column:
    return F.when(_names(T._col(text), CHATTY), "conversational").when(T._col(difficulty) == "demanding", "formal").otherwise("informational")


@F.pandas_udf(ArrayType(StringType()))
def _commonest(lists: pd.Series) -> pd.Series:
    """The commonest words of each list, the one that comes first before others as common."""
    return pd.Series([[w for w, _ in Counter(x).most_common(ANCHORS)] for x in lists], dtype=object)


def attributes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, topic, genre, register, target_tokens, structure, difficulty and key_anchors of every text; nothing is moved between tasks.

    Null texts count as empty ones: of no subject, prose, moderate, 0 tokens.  Anchors are
    single words, so they cannot repeat a passage of the text.
    """
    bound_batches(docs.sparkSession)
    t = F.coalesce("text", F.lit(""))
    topical = F.filter(words(t), lambda w: (F.length(w) > 3) & ~w.isin(*NO_TOPICS))
    told = docs.select(key, t.alias("__text"), structure(t).alias("structure"), difficulty(t).alias("difficulty"), _commonest(topical).alias("__anchors"))
    some = F.size("__anchors") > 0
    return told.select(
        key,
        F.when(some, F.array_join(F.slice("__anchors", 1, TOPICS), ", ")).otherwise("an unspecified subject").alias("topic"),
        genre("__text", "structure").alias("genre"), register("__text", "difficulty").alias("register"), T.token_count("__text").alias("target_tokens"),
        "structure", "difficulty", F.when(some, F.col("__anchors")).otherwise(F.array(F.lit("the subject of the document"))).alias("key_anchors"),
    )


def prompts(attributes: DataFrame, template: str, key: str = "doc_id") -> DataFrame:
    """key and prompt: the template with its {fields} filled in; a field that is no attribute is a KeyError.

    A first line in [brackets] is a note for readers and is left out.
    """
    template = re.sub(r"\A\s*\[[^\]]*\]\s*\n", "", template).lstrip()
    anchors = F.array_join(F.transform("key_anchors", lambda a: F.concat(F.lit("- "), a)), "\n")
    pieces = re.split(r"\{(\w+)\}", template)
    unknown = set(pieces[1::2]) - set(attributes.columns) - {"key_anchors"}
    if unknown:
        raise KeyError(f"the template names unknown fields: {sorted(unknown)}")
    filled = [F.lit(p) if k % 2 == 0 else anchors if p == "key_anchors" else F.col(p).cast("string") for k, p in enumerate(pieces)]
    return attributes.select(key, F.concat(*filled).alias("prompt"))


def token_budget(target_words: Column | str, most: int) -> Column:
    """How many tokens a text of so many words may take, between 96 and most; null stays null, a target under 1 fails the job."""
    n = T._col(target_words)
    sound = F.when(n.isNull() | (n > 0), n).otherwise(F.raise_error(F.concat(F.lit("no target of words: "), n.cast("string"))))
    wanted = F.floor(sound.cast("double") * TOKENS_TO_A_WORD * HEADROOM)
    return F.when(n.isNotNull(), F.greatest(F.lit(LEAST_BUDGET), F.least(wanted, F.lit(most))).cast("int"))


def decoding(key: Column | str, temperatures: list[float], top_ps: list[float], most: int, target_words: Column | str | None = None, *, greedy: bool = False) -> Column:
    """struct(temperature, top_p, max_new_tokens, seed) by hashes of the key alone: one pair of the grid, or greedy decoding as one more choice.

    With target_words the token budget follows the length aimed at; it does not change the
    pair or the seed.  A null key gives nulls in all that is chosen by it.
    """
    grid = [(t, p) for t in temperatures for p in top_ps] + [(0.0, 1.0)] * greedy
    which = H.digest(key, "decoding")
    budget = F.lit(most) if target_words is None else token_budget(target_words, most)
    chosen = [H.pick([float(g[k]) for g in grid], which).alias(name) for k, name in enumerate(("temperature", "top_p"))]
    return F.struct(*chosen, budget.alias("max_new_tokens"), (H.digest(key, "seed") % 2**31).alias("seed"))


def strip_wrapper(text: Column | str) -> Column:
    """The text without a closing offer of help and without a heading in its first line."""
    return T.strip(F.regexp_replace(T.strip(F.regexp_replace(T._col(text), TRAILER, "")), HEADING, ""))


def mirror_rejection(generated: Column | str, source: Column | str, target_tokens: Column | str, policy: MirrorPolicy = MirrorPolicy()) -> Column:
    """Why a generated text is refused; null if it is fine.  Null texts are empty."""
    g, s = (F.coalesce(T._col(c), F.lit("")) for c in (generated, source))
    ratio = T.token_count(g) / F.greatest(T._col(target_tokens), F.lit(1))
    # shares are over whole signatures, so the next one above the bound is as good as "more than"
    alike = dedup.texts_resemble(g, s, F.lit(policy.most_alike + 1e-6))
    early = F.when(T.strip(g) == "", "empty").when(g.rlike(PREAMBLE), "assistant_preamble").when(ratio < policy.shortest, "too_short").when(ratio > policy.longest, "too_long")
    return F.coalesce(early, F.when(alike, "near_duplicate_of_source"))
