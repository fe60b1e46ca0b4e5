"""Documents of mixed authorship and their spans: spliced paragraphs, human controls, partial rewrites."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from textmill.functions import hashing as H
from textmill.functions import spans as S
from textmill.functions import text as T
from textmill.operators.sampling import numbered

# Paragraphs that a side needs, what lies between two, bits of the plan.
LEAST_PARAGRAPHS, GAP, PLAN_BITS = 2, "\n\n", 256
# Shares of changed characters of a partial rewrite; characters of an island that counts as kept.
LEAST_CHANGED, MOST_CHANGED, ISLAND = 0.05, 0.95, 24
PIECE = re.compile(r"\A\s+|\S+\s*")


def splice_failure(human: Column | str, ai: Column | str) -> Column:
    """Why two texts cannot be spliced; null if they can."""
    few = lambda c: F.coalesce(F.size(S.paragraphs(T._col(c))), F.lit(0)) < LEAST_PARAGRAPHS
    return F.when(few(human), "human_too_few_paragraphs").when(few(ai), "ai_too_few_paragraphs")


def _planned(slot: Column) -> Column:
    """Whether the plan gives a slot to the second side: a bit of the digest, lowest first, false beyond the last."""
    digit = F.substring(F.col("__digest"), F.lit(PLAN_BITS // 4) - (slot / 4).cast("int"), F.lit(1))
    return F.when(slot < PLAN_BITS, F.getbit(F.conv(digit, 16, 10).cast("int"), slot % 4) == 1).otherwise(False)


def _placed(paragraphs: str, slots: str, label: str) -> Column:
    """Paragraphs with their slots in turn; those beyond the plan come last, in their order."""
    return F.transform(paragraphs, lambda p, k: F.struct(F.coalesce(F.get(slots, k), F.col("__n")).alias("at"), k.alias("k"), p.alias("text"), F.lit(label).alias("label")))


def _at(paragraph: Column) -> Column:
    """Where a paragraph begins in the joined text."""
    return F.aggregate(F.slice("__sizes", F.lit(1), paragraph), F.lit(0).cast("bigint"), lambda n, size: n + size)


def splice(pairs: DataFrame, label: str = "ai_generated", construction: str = "splice") -> DataFrame:
    """Documents that interleave the paragraphs of two texts, with spans that tile them.

    pairs holds human_id, human_text, ai_id, ai_text, source_group_id and split; other
    columns are dropped.  Every paragraph of both sides is used once and keeps its order
    within its side; a digest of both ids says where the sides alternate, and a plan of one
    side alone is changed in one slot.  What stands between two paragraphs belongs to the
    one before.  Pairs with a null text, or with fewer than two paragraphs on a side, give
    no row (splice_failure tells why); repeated pairs give repeated rows.
    """
    sides = pairs.withColumns({"__h": S.paragraphs(F.col("human_text")), "__a": S.paragraphs(F.col("ai_text"))})
    able = sides.where((F.size("__h") >= LEAST_PARAGRAPHS) & (F.size("__a") >= LEAST_PARAGRAPHS))
    ids = F.concat_ws("|", F.col("human_id").cast("string"), F.col("ai_id").cast("string"))
    plan = able.withColumns({"__digest": H.sha256(ids), "__n": F.size("__h") + F.size("__a")}).withColumn("__slots", F.sequence(F.lit(0), F.col("__n") - 1))
    plan = plan.withColumn("__second", F.filter("__slots", _planned))
    none, all_ = F.size("__second") == 0, F.size("__second") == F.col("__n")
    plan = plan.withColumn("__second", F.when(none, F.array((F.col("__n") / 2).cast("int"))).when(all_, F.filter("__second", lambda k: k > 0)).otherwise(F.col("__second")))
    plan = plan.withColumn("__first", F.array_except("__slots", "__second"))
    parts = plan.withColumn("__parts", F.array_sort(F.concat(_placed("__h", "__first", "human"), _placed("__a", "__second", label))))
    sized = parts.withColumns({
        "__sizes": F.transform("__parts", lambda p, k: F.length(p["text"]).cast("bigint") + F.when(k < F.col("__n") - 1, len(GAP)).otherwise(0)),
        "__edges": F.filter("__slots", lambda k: (k == 0) | (F.get("__parts", k)["label"] != F.get("__parts", k - 1)["label"])),
        "text": F.array_join(F.transform("__parts", lambda p: p["text"]), GAP),
    })
    tiled = F.transform("__edges", lambda edge, j: F.struct(
        _at(edge).alias("start_char"),
        F.coalesce(_at(F.get("__edges", j + 1)), F.length("text").cast("bigint")).alias("end_char"),
        F.get("__parts", edge)["label"].alias("label"),
    ))
    return sized.select(
        F.concat(F.lit(f"mix_{construction}_"), F.col("human_id").cast("string")).alias("doc_id"), "source_group_id", "split", "text", tiled.alias("spans"),
        F.lit(construction).alias("construction"), F.col("human_id").alias("human_source_id"), F.col("ai_id").alias("ai_source_id"),
        F.size("__h").alias("n_human_paragraphs"), F.size("__a").alias("n_ai_paragraphs"),
    )


def neighbours(docs: DataFrame, salt: str = "splice-control") -> DataFrame:
    """Pairs for splice(): each document with the next one of its split in the order of a salted hash, the last with the first.

    docs holds doc_id (unique), source_group_id, split and text.  Ranks are taken within
    ranges of hashes and texts are joined by id afterwards.  Documents that are alone in
    their split give no pair.
    """
    ranked = numbered(docs.select("doc_id", "split"), "split", H.ranked("doc_id", salt), "place", ties=("doc_id",))
    sizes = docs.groupBy(F.col("split").alias("__s")).agg(F.count(F.lit(1)).alias("__size"))
    # one row for each split
    turned = ranked.join(F.broadcast(sizes), F.col("split").eqNullSafe(F.col("__s"))).where("__size > 1")
    following = turned.select(F.col("doc_id").alias("human_id"), "split", (F.col("place") % F.col("__size") + 1).alias("place"))
    here = ranked.select(F.col("doc_id").alias("ai_id"), F.col("split").alias("__split"), F.col("place").alias("__place"))
    ids = following.join(here, F.col("split").eqNullSafe(F.col("__split")) & (F.col("place") == F.col("__place"))).select("human_id", "ai_id", "split")
    first = docs.select(F.col("doc_id").alias("human_id"), F.col("text").alias("human_text"), "source_group_id")
    second = docs.select(F.col("doc_id").alias("ai_id"), F.col("text").alias("ai_text"))
    return ids.join(first, "human_id").join(second, "ai_id")


def splice_controls(docs: DataFrame) -> DataFrame:
    """Two human documents spliced, all of it labelled human: seams without a second author."""
    return splice(neighbours(docs), "human", "splice_control")


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _compared(before: pd.Series, after: pd.Series) -> pd.Series:
    """Runs of the later text as start, end and 1 where words are kept."""
    return pd.Series([_runs(x, y) for x, y in zip(before, after, strict=True)], dtype=object)


def _runs(before: str | None, after: str | None) -> list[list[int]]:
    pieces = PIECE.findall(after or "")
    at = np.cumsum([0] + [len(p) for p in pieces])
    found = SequenceMatcher(None, PIECE.findall(before or ""), pieces, autojunk=False).get_opcodes()
    runs = np.array([(at[j], at[k], kind == "equal") for kind, _, _, j, k in found if k > j], dtype=np.int64).reshape(-1, 3)
    changed = np.pad(runs[:, 2] == 0, 1)
    islands = (runs[:, 1] - runs[:, 0] < ISLAND) & changed[:-2] & changed[2:]
    kept = (runs[:, 2] == 1) & ~islands
    edges = np.flatnonzero(np.diff(kept, prepend=~kept[:1]))
    ends = np.append(runs[edges[1:], 0], at[-1:])
    return [[int(runs[e, 0]), int(end), int(kept[e])] for e, end in zip(edges, ends, strict=False)]


def edit_spans(original: Column | str, edited: Column | str, label: str = "ai_assisted") -> Column:
    """Spans of the edited text: human where words of the original are kept, label elsewhere.

    Words are compared with the white space behind them; kept runs of less than 24
    characters between two changes count as changed.  A null or empty edited text has no
    spans, a null original counts as empty.  The comparison's time grows with the product
    of both lengths in the worst case, its memory with their sum.
    """
    return F.transform(_compared(T._col(original), T._col(edited)), lambda r: F.struct(r[0].alias("start_char"), r[1].alias("end_char"), F.when(r[2] == 1, "human").otherwise(label).alias("label")))


def edited_documents(pairs: DataFrame) -> DataFrame:
    """Partial rewrites with spans, over human_id, human_text, edited_text, source_group_id, split and editor.

    Texts equal but for white space at the ends, null ones, and rewrites that changed less
    than 5 or more than 95 per cent of the characters give no row.
    """
    other = pairs.where(T.strip(F.col("human_text")) != T.strip(F.col("edited_text")))
    told = other.withColumn("spans", edit_spans("human_text", "edited_text")).withColumn("__share", S.ai_char_fraction(F.col("edited_text"), F.col("spans")))
    return told.where(F.col("__share").between(LEAST_CHANGED, MOST_CHANGED)).select(
        F.concat(F.lit("mix_edit_"), F.col("human_id").cast("string")).alias("doc_id"), "source_group_id", "split", F.col("edited_text").alias("text"), "spans",
        F.lit("edit_diff").alias("construction"), F.col("human_id").alias("human_source_id"), F.col("editor").alias("ai_source_id"),
    )
