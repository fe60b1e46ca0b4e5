"""Controlled text perturbations, the same for a document and a severity on every run.

Each attack belongs to one of three kinds: changes of single characters, which are drawn
for a whole Arrow batch of texts at once; changes of listed words; and changes of
sentences, which are Spark expressions.  Draws are hashes of the document, the attack,
the severity and the place, so tasks that run again give the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textmill.functions import text as T
from textmill.operators import dedup
from textmill.operators.tables import bound_batches

# Letters and their lookalikes.
HOMOGLYPHS = {
    "a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х",
}
# Words and their synonyms.
SYNONYMS = {
    "big": "large", "small": "little", "begin": "start", "end": "finish", "show": "display", "use": "employ",
    "help": "assist", "need": "require", "make": "create", "get": "obtain", "many": "numerous", "important": "significant",
    "however": "nevertheless", "because": "since", "about": "regarding", "often": "frequently", "quickly": "rapidly", "difficult": "challenging",
}
# Severities of each attack.
SEVERITIES = {
    "whitespace_perturb": (0.02, 0.10), "zero_width_insert": (0.01, 0.05), "paragraph_insert": (0.2, 0.5), "homoglyph_substitute": (0.01, 0.05, 0.20),
    "synonym_swap": (0.05, 0.15), "sentence_reorder": (0.1, 0.3), "case_perturb": (0.02, 0.10), "article_deletion": (0.2, 0.5),
}
# Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[.!?])\s+"

#: What each character attack makes of a character that is drawn.
CHARACTERS: dict[str, Callable[[str], str]] = {
    "whitespace_perturb": lambda c: "  " if c == " " else c,
    "zero_width_insert": lambda c: c + "​",
    "homoglyph_substitute": lambda c: HOMOGLYPHS.get(c, c),
    "case_perturb": lambda c: c.upper() if c.islower() else c.lower(),
}


def _listed(words) -> re.Pattern:
    """The words, in either case, where they stand alone, that is not as part of a compound with hyphens or apostrophes.

    What stands before is looked at after a word's first letter, so that the pattern is tried where a word can begin only.
    """
    # the Kelvin sign is lowered to a k
    either = lambda word: "".join(f"[{c}{c.upper()}{'\u212a' * (c == 'k')}]" for c in word)
    first = "".join(sorted({x for w in words for x in (w[0], w[0].upper())}))
    rest = "|".join(f"(?<={either(w[0])}){either(w[1:])}" for w in words)
    return re.compile(rf"([{first}](?<!\w.)(?<!\w['-].)(?<!\w['-]['-].)(?:{rest}))(?!['-]*\w)", re.DOTALL)


def _synonym(word: str) -> str:
    new = SYNONYMS[word.lower()]
    return new.capitalize() if word[:1].isupper() else new


#: The words of each word attack, what becomes of one that is drawn, and what is done to the text at the end.
WORDS: dict[str, tuple[re.Pattern, Callable[[str], str], Callable[[str], str]]] = {
    "synonym_swap": (_listed(SYNONYMS), _synonym, lambda t: t),
    "article_deletion": (_listed(("a", "an", "the")), lambda w: "", lambda t: re.sub(r"\s{2,}", " ", t).strip()),
}
SENTENCES = ("paragraph_insert", "sentence_reorder")


def _drawn(seeds: np.ndarray, counts: np.ndarray, severities: np.ndarray) -> np.ndarray:
    """Which places are drawn, over rows of `counts` places laid end to end."""
    place = np.arange(counts.sum(), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
    x = np.repeat(seeds, counts) ^ (place * np.uint64(0xD6E8FEB86659FD93))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) < np.repeat(severities * 2.0**64, counts)


def _characters(texts: list[str], change: Callable[[str], str], seeds: np.ndarray, severities: np.ndarray) -> list[str]:
    """Texts with the drawn characters changed: each distinct one is changed once, then put where it was drawn."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(_drawn(seeds, counts, severities))
    distinct, which = np.unique(codes[at], return_inverse=True)
    old = [chr(c) for c in distinct.tolist()]
    made = [np.frombuffer(change(c).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for c in old]
    sizes = np.ones(len(codes), dtype=np.int64)
    size_of = np.array([len(m) for m in made], dtype=np.int64)
    sizes[at] = size_of[which]
    pool, begin_of = np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum(size_of) - size_of
    ends = np.cumsum(sizes)
    out = np.repeat(codes, sizes)
    within = _within(sizes[at])
    out[np.repeat(ends[at] - sizes[at], sizes[at]) + within] = pool[np.repeat(begin_of[which], sizes[at]) + within]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    flat = out.tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _words(text: str, attack: str, seed: np.uint64, severity: float) -> str:
    """text with the drawn ones of its listed words changed; places count listed words."""
    pattern, change, tidy = WORDS[attack]
    parts = pattern.split(text)
    hits = _drawn(np.array([seed]), np.array([len(parts) // 2]), np.array([severity]))
    for k in (2 * np.flatnonzero(hits) + 1).tolist():
        parts[k] = change(parts[k])
    return tidy("".join(parts))


def _changed(text: pd.Series, attack: pd.Series, seed: pd.Series, severity: pd.Series) -> pd.Series:
    """Texts under character and word attacks; null texts stay null."""
    out = pd.Series(None, index=text.index, dtype=object)
    real = text.notna()
    for name, at in attack[real].groupby(attack[real]).groups.items():
        seeds, levels = seed[at].to_numpy(dtype=np.int64).view(np.uint64), severity[at].to_numpy()
        if name in CHARACTERS:
            out[at] = _characters(text[at].tolist(), CHARACTERS[name], seeds, levels)
        else:
            out[at] = [_words(t, name, s, v) for t, s, v in zip(text[at], seeds, levels, strict=True)]
    return out


#: Marked so that the optimiser does not repeat it in each column that reads its result.
_changed_once = F.pandas_udf(_changed, StringType()).asNondeterministic()


def _share(seed: Column, place: Column) -> Column:
    """A fixed number of 0 to 1 for a place of the row."""
    return F.shiftrightunsigned(F.xxhash64(seed, place), 11) / F.lit(2.0**53)


def _sentences(plan: list[tuple[Column, Column, Column]]) -> Column:
    """Array of a text under sentence attacks (attack, severity, seed); a text of one sentence stays as it is.

    New paragraphs follow the sentences drawn.  Sentences that are drawn move behind their
    next neighbour; one moves at least.
    """

    def told(parts: Column, attack: Column, severity: Column, seed: Column) -> Column:
        n = F.size(parts)
        parted = F.array_join(F.transform(parts, lambda s, k: F.when(_share(seed, k) < severity, F.concat(s, F.lit("\n\n"))).otherwise(s)), " ")
        always = F.pmod(F.xxhash64(seed, F.lit("first")), F.greatest(n - 1, F.lit(1)))
        turn = lambda k: k + F.when((k == always) | (_share(seed, k) < severity), 1.5).otherwise(0.0)
        ordered = F.array_sort(F.transform(parts, lambda s, k: F.struct(turn(k).alias("turn"), k.alias("k"), s.alias("s"))))
        moved = F.array_join(F.transform(ordered, lambda x: x["s"]), " ")
        return F.when(n < 2, F.col("text")).when(attack == "paragraph_insert", parted).otherwise(moved)

    # bound, as a place would otherwise split the text again for every sentence of it
    return T.bound(F.split("text", SENTENCE_END), lambda parts: F.array(*[told(parts, *p) for p in plan]))


def _require_known(attacks: dict[str, tuple[float, ...]]) -> None:
    unknown = set(attacks) - {*CHARACTERS, *WORDS, *SENTENCES}
    if unknown:
        raise ValueError(f"unknown attacks {sorted(unknown)}")


def attack_matrix(docs: DataFrame, attacks: dict[str, tuple[float, ...]] = SEVERITIES, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, attack, severity and attacked: every document under every attack and severity; null texts stay null.

    Severity is the chance of every place that an attack can change.  keep names columns
    of docs that are carried on, so that what is worked out of a text is worked out once.
    """
    _require_known(attacks)
    # whole texts: batches bounded by bytes
    bound_batches(docs.sparkSession)
    columns = ("doc_id", "text", *keep)

    plan = F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(float(s)).alias("severity")) for a in attacks for s in attacks[a]])
    rows = docs.select(*columns, F.explode(plan).alias("p")).select(*columns, "p.attack", "p.severity").withColumn("seed", F.xxhash64("doc_id", "attack", "severity"))
    native = F.col("attack").isin(*SENTENCES)
    # one branch, so that the rows of a document come after each other; sentences do not go to Python
    moved = _sentences([(F.col("attack"), F.col("severity"), F.col("seed"))])[0]
    attacked = moved if set(attacks) <= set(SENTENCES) else _changed_once(F.when(~native, F.col("text")), "attack", "seed", "severity")
    if set(attacks) & set(SENTENCES) and set(attacks) - set(SENTENCES):
        attacked = F.when(native, moved).otherwise(attacked)
    return rows.withColumn("attacked", attacked).drop("seed")


def is_noop(original: Column | str, changed: Column | str) -> Column:
    return T._col(original).eqNullSafe(T._col(changed))


def survives_preprocessing(original: Column | str, changed: Column | str) -> Column:
    return T.normalize(original) != T.normalize(changed)


def fold_homoglyphs(text: Column | str) -> Column:
    fold = lambda t: F.when(T.is_ascii(t), t).otherwise(F.translate(t, "".join(HOMOGLYPHS.values()), "".join(HOMOGLYPHS)))
    return T.bound(T._col(text), fold)


def plain(text: Column | str) -> Column:
    """What preserves_meaning compares: the text folded and normalised."""
    return T.normalize(fold_homoglyphs(text))


_IMITATIONS, _IMITATED = "".join(HOMOGLYPHS.values()), "".join(HOMOGLYPHS)
_IMITATES = re.compile(f"[{_IMITATIONS}]")


def _forms_of(text: str, folds: bool) -> tuple[str | None, str | None, str | None, bool]:
    """smoothed() of a text, of it with confusable letters folded and of it with homoglyphs folded, and whether they are marked; what is as the one before, or the text, is None."""
    whole = T.composed(text)
    normalised, marked = T.smoothed(whole)
    folded = plain = None
    if not text.isascii():
        if folds and (other := T.confusables_folded(whole)) != whole:
            folded = T.smoothed(other)[0]
        if _IMITATES.search(text):
            plain = T.smoothed(T.composed(T.replaced(text, _IMITATIONS, _IMITATED)))[0]
    return None if normalised == text else normalised, folded, plain, marked


def preserves_meaning(original: Column | str, changed: Column | str, least: float = 0.5) -> Column:
    """Whether MinHash signatures of both texts, folded and normalised, agree in a share of at least `least`; false for empty texts."""
    a, b = plain(original), plain(changed)
    return dedup.texts_resemble(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), F.lit(least))


#: What judged_matrix makes in one pass.
_MADE = "attack string, severity double, attacked string, noop boolean, normalised string, folded string, marked boolean, known string, known_marked boolean, plain string, valid boolean"
# Fixed value: characters of the documents whose rows are made at once, 17 times as many.
CUT = 1 << 18


def _made(plan: list[tuple[str, float]], forms: bool, folds: bool, least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents (text, seeds of the plan's attacks, moved: what sentence attacks make of the text) to rows of _MADE, those of a document after each other."""

    def under(texts: list[str], seeds: np.ndarray, moved: list[np.ndarray]) -> list[list[str]]:
        natives = iter(range(len(plan)))
        out = []
        for k, (attack, severity) in enumerate(plan):
            if attack in SENTENCES:
                at = next(natives)
                out.append([m[at] for m in moved])
            elif attack in CHARACTERS:
                out.append(_characters(texts, CHARACTERS[attack], seeds[:, k], np.full(len(texts), severity)))
            else:
                out.append([_words(t, attack, s, severity) for t, s in zip(texts, seeds[:, k], strict=True)])
        return out

    def judged(text: str, attacked: list[str], resembles: dedup.Resemblance) -> Iterator[tuple]:
        normalised, _, plain, known_marked = _forms_of(text, False)
        known = next(x for x in (plain, normalised, text) if x is not None)
        for (attack, severity), new in zip(plan, attacked, strict=True):
            noop = new == text
            normalised, folded, plain, marked = (None, None, None, False) if noop else _forms_of(new, folds)
            if not noop:
                plain = next(x for x in (plain, normalised, new) if x is not None)
            if not forms:
                normalised = folded = None
            if marked or known_marked:
                yield attack, severity, new, noop, normalised, folded, marked, known, known_marked, plain, None
            else:
                yield attack, severity, new, noop, normalised, folded, False, None, False, None, resembles(known, plain, least)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resembles = dedup.Resemblance()
        for part in batches:
            ends = part["text"].fillna("").str.len().cumsum() // CUT
            for _, cut in part.groupby(ends.to_numpy()):
                real = cut[cut["text"].notna()]
                texts = real["text"].tolist()
                seeds = np.array(real["seeds"].tolist(), dtype=np.int64).reshape(len(texts), len(plan)).view(np.uint64)
                each = zip(*under(texts, seeds, real["moved"].tolist()), strict=True) if texts else ()
                out = [row for text, attacked in zip(texts, each, strict=True) for row in judged(text, list(attacked), resembles)]
                out += [(a, s, None, True, None, None, False, None, False, None, False) for a, s in plan] * (len(cut) - len(real))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _MADE.split(", ")], dtype=object)

    return rows


def _finished(made: DataFrame, text: Column) -> DataFrame:
    """made with normalised and folded of its column text, from what _forms_of() gives of them."""
    whole = made.withColumn("normalised", T.finished(F.coalesce("normalised", text), F.col("marked")))
    return whole.withColumn("folded", F.coalesce(T.finished(F.col("folded"), F.col("marked")), F.col("normalised")))


def normal_forms(docs: DataFrame, *, folds: bool = True) -> DataFrame:
    """text, normalised and, if asked for, folded of documents, in a pass like that of judged_matrix; no text may be null."""
    bound_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = ((t, *_forms_of(t, folds)) for t in part["text"])
            yield pd.DataFrame([(t, n, f, m) for t, n, f, _, m in found], columns=["text", "normalised", "folded", "marked"], dtype=object)

    made = docs.select("text").mapInPandas(rows, "text string, normalised string, folded string, marked boolean")
    return _finished(made, F.col("text")).drop("marked")


def judged_matrix(docs: DataFrame, attacks: dict[str, tuple[float, ...]] = SEVERITIES, *, forms: bool = True, folds: bool = True, least: float = 0.5) -> DataFrame:
    """attack_matrix judged: attack, severity, attacked, noop, normalised, folded, known, plain and valid.

    normalised, and folded if asked for, are forms of attacked, null for no-ops.  valid is
    preserves_meaning of the unchanged text, or null where settled() finds it from known
    and plain: where a text holds what may be markup, which Spark strips.

    All is one pass that takes documents and gives rows, as a function of columns would
    leave the rows, with all their texts, to wait in memory or on disk for what is in
    Python or on the way there, however little of a row was sent.
    """
    _require_known(attacks)
    bound_batches(docs.sparkSession)
    plan = [(a, float(s)) for a in attacks for s in attacks[a]]
    of = lambda a, s: (F.lit(a), F.lit(s), F.xxhash64("doc_id", F.lit(a), F.lit(s)))
    native = [of(a, s) for a, s in plan if a in SENTENCES]
    moved = _sentences(native) if native else F.array().cast("array<string>")
    sent = docs.select("text", F.array(*[of(a, s)[2] for a, s in plan]).alias("seeds"), moved.alias("moved"))
    made = sent.mapInPandas(_made(plan, forms, folds, least), _MADE)
    if forms:
        made = _finished(made, F.when(~F.col("noop"), F.col("attacked")))
    return made.withColumns({"known": T.finished(F.col("known"), F.col("known_marked")), "plain": T.finished(F.col("plain"), F.col("marked"))}).drop("marked", "known_marked")


def settled(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """rows of judged_matrix, with what other columns are wanted, without known and plain, and valid where it was null."""
    kept = [c for c in rows.columns if c not in ("known", "plain")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resembles = dedup.Resemblance()
        for b in batches:
            told = zip(*(b.column(c).to_pylist() for c in ("valid", "known", "plain")), strict=True)
            valid = pa.array([resembles(known, plain, least) if v is None else v for v, known, plain in told], pa.bool_())
            yield pa.RecordBatch.from_arrays([valid if c == "valid" else b.column(c) for c in kept], names=kept)

    return rows.mapInArrow(judge, rows.select(*kept).schema)


def attack_report(scored: DataFrame, threshold: float) -> DataFrame:
    """attack, severity, n, misses at the threshold, no-ops and invalid ones (which count in no rate) over (attack, severity, text and attacked or noop, s and, where it was judged, valid)."""
    valid = F.col("valid") if "valid" in scored.columns else F.lit(True)
    noop = F.col("noop") if "noop" in scored.columns else is_noop("text", "attacked")
    return scored.groupBy("attack", "severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(valid, (F.col("s") < threshold).cast("double"))).alias("fnr"),
        F.count(F.when(noop, 1)).alias("no_ops"),
        F.count(F.when(~valid, 1)).alias("invalid"),
    )
