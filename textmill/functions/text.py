"""Column functions over texts: counts, ratios, normalisation, language, personal data.

All but Unicode compatibility normalisation are Spark expressions.  A null text gives
null, except in ratios, which have a defined value for empty texts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space and as part of a word.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = rf"[^{SPACE}]+"
# The same white space one by one; what stands between words; a place that is no printable ASCII, which rules most places out by one comparison.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NO_WORD = r"[^\p{L}\p{N}_]+"
UNPRINTED = "(?![!-~])"
# Texts of these alone, most texts, need no compatibility normalisation and hold no white space but blanks and newlines; ASCII stands in a class of its own.
PLAIN = (
    r"\A[\n\x{20}-\x{7e}[\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}"
    r"\x{400}-\x{45f}\x{200b}-\x{200d}\x{2013}\x{2014}\x{2018}-\x{201d}\x{2060}\x{3041}-\x{3094}\x{30a1}-\x{30fa}\x{4e00}-\x{9fcb}\x{feff}]]*+\z"
)
# The same without the capital I with a dot, which two characters replace when lowered; the words of such texts keep their number and lengths.
STEADY = PLAIN.replace(r"\x{bf}-\x{131}", r"\x{bf}-\x{12f}\x{131}")

# The English function words of the language heuristic, and its full share.
ENGLISH = (
    "the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "with", "as",
    "was", "on", "be", "by", "this", "are", "from", "at", "or", "an", "have", "not",
)
FULL_SHARE = 0.25

# Characters that are deleted, and letters that imitate Latin ones.
INVISIBLE = "​‌‍⁠﻿­᠎"
CONFUSABLE = "авсенкморѕтхуіјԁѡցАВСЕНКМОРЅТХУІЈԀѠГЬЯФαονρτυχικμεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "abcehkmopstxyijdwgABCEHKMOPSTXYIJDWrbROaovptuxikueABEZHIKMNOPTYX"

# Markup patterns and entities, in the order in which they are applied.
SCRIPT_OR_STYLE = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
MARKDOWN_LINK = r"\[([^\]]*)\]\([^)]*\)"
TAG = r"<[^>]+>"
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
OTHER_ENTITY = r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);"

# Personal data by kind, in the order in which it is redacted.
PERSONAL = {
    "EMAIL": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b",
    "PHONE": r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "SSN": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "IBAN": r"(?U)\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
    "CREDIT_CARD": r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
    "IP": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
}


# The default policies.
@dataclass(frozen=True)
class LengthPolicy:
    min_chars: int = 200
    min_tokens: int = 50
    max_tokens: int = 20_000


@dataclass(frozen=True)
class QualityPolicy:
    max_symbol_ratio: float = 0.20
    max_repeated_line_ratio: float = 0.30
    min_mean_word_length: float = 2.5
    max_mean_word_length: float = 12.0
    min_unique_word_ratio: float = 0.20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_count(text: Column | str) -> Column:
    """Number of tokens between white space; texts are split at it, as counting what is not of it takes eight times as long.  Plain texts are split at blanks, which takes no pattern."""

    def counted(t: Column) -> Column:
        plain = F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " ")
        return F.array_size(F.array_remove(F.when(t.rlike(PLAIN), plain).otherwise(F.split(t, f"{UNPRINTED}[{SPACE}]+")), "")).cast("long")

    return bound(_col(text), counted)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0))


def symbol_ratio(text: Column | str) -> Column:
    """Share of characters that are neither of a word nor white space; an empty text has 1."""
    t = _col(text)
    symbols = F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}_{SPACE}]+", ""))
    return F.when(F.length(t) == 0, 1.0).otherwise(symbols / F.length(t))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def repeated_line_ratio(text: Column | str) -> Column:
    """Share of non-blank lines beyond the first of their kind; fewer than two lines have 0."""
    return bound(_lines(_col(text)), lambda lines: F.when(F.size(lines) < 2, 0.0).otherwise(1 - F.size(F.array_distinct(lines)) / F.size(lines)))


def mean_word_length(text: Column | str) -> Column:
    found = F.array_remove(F.split(_col(text), NO_WORD), "")
    return bound(found, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.length(F.array_join(w, "")) / F.size(w)))


def unique_word_ratio(text: Column | str) -> Column:
    return bound(words(F.lower(_col(text))), lambda found: F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.array_distinct(found)) / F.size(found)))


def quality(text: Column | str) -> Column:
    """struct(symbols, repeated, word_length, distinct): the ratios and the mean above, of the words of steady texts found once for all."""

    def told(symbols: Column, word_length: Column, distinct: Column, t: Column) -> Column:
        return F.struct(symbols.alias("symbols"), repeated_line_ratio(t).alias("repeated"), word_length.alias("word_length"), distinct.alias("distinct"))

    def steady(t: Column) -> Column:
        def ratios(c: Column) -> Column:
            symbols = F.when(F.length(t) == 0, 1.0).otherwise((c["solid"] - c["chars"]) / F.length(t))
            return told(symbols, *[F.when(c["n"] == 0, 0.0).otherwise(x / c["n"]) for x in (c["chars"], c["different"])], t)

        # what is not white space, and of it what stands in words
        solid = F.length(F.replace(F.replace(t, F.lit(" ")), F.lit("\n")))
        found = F.array_remove(F.split(F.lower(t), NO_WORD), "")
        counts = bound(found, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), F.size(F.array_distinct(w)).alias("different"), solid.alias("solid")))
        return bound(counts, ratios)

    return bound(_col(text), lambda t: F.when(t.rlike(STEADY), steady(t)).otherwise(told(symbol_ratio(t), mean_word_length(t), unique_word_ratio(t), t)))


def first_reason(reasons: list[tuple[Column, str]]) -> Column:
    """The first reason whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def all_reasons(reasons: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in reasons]))


def length_reasons(text: Column | str, tokens: Column | str, policy: LengthPolicy = LengthPolicy()) -> list[tuple[Column, str]]:
    """Reasons by a text's length and by its token_count, which is a column of its own so that it is counted once."""
    t, n = _col(text), _col(tokens)
    return [
        (F.length(t) < policy.min_chars, "too_short_chars"),
        (n < policy.min_tokens, "too_short_tokens"),
        (n > policy.max_tokens, "too_long_tokens"),
    ]


def quality_reasons(measured: Column | str, policy: QualityPolicy = QualityPolicy()) -> list[tuple[Column, str]]:
    """Reasons by a text's quality(), a column of its own so that it is measured once."""
    q = _col(measured)
    return [
        (q["symbols"] > policy.max_symbol_ratio, "high_symbol_ratio"),
        (q["repeated"] > policy.max_repeated_line_ratio, "repetitive_lines"),
        (~q["word_length"].between(policy.min_mean_word_length, policy.max_mean_word_length), "anomalous_word_length"),
        (q["distinct"] < policy.min_unique_word_ratio, "low_lexical_diversity"),
    ]


def language(text: Column | str, upstream: Column | None = None) -> Column:
    """struct(language, score, detector): the upstream (language, score) where there is one, else the share of English function words."""

    def judged(counts: Column) -> Column:
        raw = F.least(counts["hits"] / counts["n"] / FULL_SHARE, F.lit(1.0))
        score = F.when(counts["n"] == 0, 0.0).otherwise(F.bround(raw, 4))
        name = F.when((counts["n"] > 0) & (raw >= 0.5), "en").otherwise("unknown")
        return F.struct(name.alias("language"), score.alias("score"), F.lit("heuristic").alias("detector"))

    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"(?U)\b[a-z']+\b"), F.lit(0))
    own = bound(bound(found, lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(*ENGLISH))).alias("hits"))), judged)
    if upstream is None:
        return own
    given = F.struct(upstream["language"].alias("language"), upstream["score"].cast("double").alias("score"), F.lit("upstream").alias("detector"))
    return F.when(upstream.isNotNull(), given).otherwise(own)


def _nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which Spark has no function for."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


nfkc = F.pandas_udf(_nfkc, StringType())
#: The same, marked so that the optimiser neither repeats it in the columns that read its result nor moves filters below it.
nfkc_once = F.pandas_udf(_nfkc, StringType()).asNondeterministic()


def strip_markup(text: Column | str) -> Column:
    """Scripts and styles, Markdown links, tags and entities, in this order and once; patterns are tried where their first characters occur."""

    def entities(t: Column) -> Column:
        for entity, value in ENTITIES.items():
            t = F.replace(t, F.lit(entity), F.lit(value))
        return F.regexp_replace(t, OTHER_ENTITY, " ")

    t = _where(_col(text), _holds("<"), lambda t: F.regexp_replace(t, SCRIPT_OR_STYLE, " "))
    t = _where(t, _holds("]("), lambda t: F.regexp_replace(t, MARKDOWN_LINK, "$1"))
    t = _where(t, _holds("<"), lambda t: F.regexp_replace(t, TAG, " "))
    return _where(t, _holds("&"), entities)


def _holds(*parts: str) -> Callable[[Column], Column]:
    return lambda t: functools.reduce(Column.__or__, [F.contains(t, F.lit(p)) for p in parts])


def _where(text: Column, condition: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The text, changed where the condition holds."""
    return bound(text, lambda t: F.when(condition(t), change(t)).otherwise(t))


def strip_invisible(text: Column | str) -> Column:
    return _where(_col(text), lambda t: ~is_ascii(t) & _holds(*INVISIBLE)(t), lambda t: F.regexp_replace(t, rf"{UNPRINTED}[{INVISIBLE}]+", ""))


def fold_confusable_letters(text: Column | str) -> Column:
    return _where(_col(text), lambda t: ~is_ascii(t), lambda t: F.translate(t, CONFUSABLE, LATIN))


def collapse_whitespace(text: Column | str) -> Column:
    """Runs of blanks become one space, three or more newlines two; lines and the whole are stripped."""
    blank = r"[ \t\x{a0}\x{2000}-\x{200a}]"
    # only what changes is matched: a single space and a newline without blanks beside it stay
    t = F.regexp_replace(_col(text), rf"{UNPRINTED}(?:{blank}{{2,}}+|[\t\x{{a0}}\x{{2000}}-\x{{200a}}])", " ")
    t = _where(t, lambda t: F.contains(t, F.lit("\n\n\n")), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    edge = SPACE.replace(r"\t-\r", r"\t\x{b}-\r")
    return strip(_where(t, lambda t: F.contains(t, F.lit("\n")), lambda t: F.regexp_replace(t, rf"{UNPRINTED}(?:[{edge}]++\n[{edge}]*|\n[{edge}]+)", "\n")))


def _collapse_plain(text: Column) -> Column:
    """collapse_whitespace of a text without white space but blanks and newlines."""
    t = _where(text, _holds("  "), lambda t: F.regexp_replace(t, " {2,}", " "))
    t = _where(t, _holds("\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return F.btrim(_where(t, _holds(" \n", "\n "), lambda t: F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), F.lit(" \n"))


def normalize(text: Column | str, *, fold_confusables: bool = False, once: bool = False) -> Column:
    """The normalised text; once: a column of this is worked out once a row, however many others read it."""
    t = _col(text)
    fold = fold_confusable_letters if fold_confusables else lambda t: t
    # plain texts do not go to Python, and keep to what can change them
    composed = (nfkc_once if once else nfkc)(F.when(~(t.rlike(PLAIN) & ~F.contains(t, F.lit("&"))), t))
    whole = lambda t: collapse_whitespace(strip_markup(strip_invisible(fold(t))))
    plain = lambda t: _collapse_plain(strip_markup(strip_invisible(fold(t))))
    return bound(F.struct(composed.alias("composed"), t.alias("text")), lambda x: F.when(x["composed"].isNull(), plain(x["text"])).otherwise(whole(x["composed"])))


# the same steps for a text that is in Python already: a pass of a pattern over it costs Spark more than the way here and back
_CAN_FOLD = re.compile(f"[{CONFUSABLE}]")
_BLANKS = re.compile("[ \t]{2,}|\t")
_NEWLINES = re.compile("\n{3,}")
_EDGE = SPACES.replace("\n", "")


def composed(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFKC", t)


def replaced(t: str, letters: str, by: str) -> str:
    """t with letters replaced by those at their places: letter by letter, which is faster than str.translate."""
    for old, new in zip(letters, by, strict=True):
        t = t.replace(old, new)
    return t


def confusables_folded(t: str) -> str:
    return t if t.isascii() or not _CAN_FOLD.search(t) else replaced(t, CONFUSABLE, LATIN)


def smoothed(t: str) -> tuple[str, bool]:
    """A composed text as normalize() has it, and False; with True, one that strip_markup may change, and so is without its last steps, which finished() takes."""
    if not t.isascii():
        for c in INVISIBLE:
            if c in t:
                t = t.replace(c, "")
    if "&" in t or "<" in t or "](" in t:
        return t, True
    # the only blanks that a composed text holds
    if "  " in t or "\t" in t:
        t = _BLANKS.sub(" ", t)
    if "\n" in t:
        t = "\n".join([line.strip(_EDGE) for line in _NEWLINES.sub("\n\n", t).split("\n")])
    return t.strip(SPACES), False


def finished(text: Column, marked: Column) -> Column:
    """What smoothed() gives, with its last steps where it is marked."""
    return F.when(marked, collapse_whitespace(strip_markup(text))).otherwise(text)


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits have a valid check digit; other characters are passed over."""
    only = F.regexp_replace(digits, r"[^0-9]", "")
    return F.length(only).between(13, 19) & F.call_function("luhn_check", only)


def personal_data(text: Column | str) -> Column:
    """Sorted kinds of personal data in a text."""
    t = _col(text)
    kinds = []
    for kind, pattern in PERSONAL.items():
        found = t.rlike(pattern)
        if kind == "CREDIT_CARD":
            found = F.exists(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), luhn)
        kinds.append(F.when(found, F.lit(kind)))
    return F.array_sort(F.array_compact(F.array(*kinds)))


def _redacted(text: Column, kind: str) -> Column:
    pattern, mark = PERSONAL[kind], f"[{kind}]"
    if kind != "CREDIT_CARD":
        return F.regexp_replace(text, pattern, mark)
    # what stands between the matches, with each match kept or replaced
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.concat(p, F.coalesce(F.when(luhn(m), F.lit(mark)).otherwise(m), F.lit(""))))
    return F.array_join(parts, "")


def redact(text: Column | str) -> Column:
    """struct(text, flags): personal data replaced by its kind in brackets, kind after kind, and the kinds replaced, sorted."""
    t, flags = _col(text), []
    for kind in PERSONAL:
        after = _redacted(t, kind)
        flags.append(F.when(after != t, F.lit(kind)))
        t = after
    return F.struct(t.alias("text"), F.array_sort(F.array_compact(F.array(*flags))).alias("flags"))


def with_redacted(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with redact(text) as column name; each kind is a projection of its own, so that it is computed once."""
    steps = [text]
    for kind in PERSONAL:
        steps.append(f"__{kind}")
        df = df.withColumn(steps[-1], _redacted(F.col(steps[-2]), kind))
    flags = [F.when(F.col(after) != F.col(before), F.lit(kind)) for before, after, kind in zip(steps, steps[1:], PERSONAL, strict=False)]
    found = F.struct(F.col(steps[-1]).alias("text"), F.array_sort(F.array_compact(F.array(*flags))).alias("flags"))
    return df.withColumn(name, found).drop(*steps[1:])
