"""Streams of corpus rows and of feedback on verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of a feedback item and the moves between them.
MOVES = {
    "submitted": ("triaged", "rejected"),
    "triaged": ("verified", "rejected"),
    "verified": (),
    "rejected": (),
}
STEPS = "item_id string, state string, label string, moved boolean"


def first_of_content(stream: DataFrame, delay: str, content: str = "content_sha256", at: str = "acquired_at") -> DataFrame:
    """Rows whose content has not been seen within the delay; state older than it is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([content])


def counts_by_window(stream: DataFrame, at: str, delay: str, length: str, *keys: str) -> DataFrame:
    """window and keys with n, for windows that the watermark has closed."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def step(state: str | None, to: str, label: str | None) -> bool:
    """Whether an item may move; verification needs a label."""
    if state is None:
        return to == "submitted"
    return to in MOVES[state] and (to != "verified" or bool(label))


def _after(state: str | None, rows: list[tuple[str, str | None]]) -> tuple[str | None, list[tuple[str, str | None, bool]]]:
    out = []
    for to, label in rows:
        ok = step(state, to, label)
        state = to if ok else state
        out.append((to, label, ok))
    return state, out


def transitions(stream: DataFrame) -> DataFrame:
    """item_id, state, label and moved for every requested move (item_id, seq, state, label) of a stream; each item's state is kept."""

    def rows(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        asked = pd.concat(list(parts)).sort_values("seq")
        now, out = _after(now, list(zip(asked["state"], asked["label"], strict=True)))
        if now is not None:
            state.update((now,))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["item_id", "state", "label", "moved"])

    return stream.groupBy("item_id").applyInPandasWithState(rows, STEPS, "state string", "append", "NoTimeout")


def replay(moves: DataFrame) -> DataFrame:
    """The same over a whole table; an item has a few moves."""

    def rows(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        _, out = _after(None, list(zip(part["state"], part["label"], strict=True)))
        return pd.DataFrame([(key[0], *x) for x in out], columns=["item_id", "state", "label", "moved"])

    return moves.groupBy("item_id").applyInPandas(rows, STEPS)


def verified(steps: DataFrame) -> DataFrame:
    """Items that reached verification, which alone go on to the failure atlas."""
    return steps.where("moved and state = 'verified'").select("item_id", "label")


def queue_stats(states: DataFrame) -> DataFrame:
    """One row over (item_id, state): counts, pending ones, and the share of ended items that were rejected."""
    of = lambda s: F.count(F.when(F.col("state") == s, 1))
    ended = of("verified") + of("rejected")
    return states.agg(*[of(s).alias(s) for s in MOVES], (of("submitted") + of("triaged")).alias("pending"), F.when(ended > 0, of("rejected") / ended).alias("rejection_rate"))
