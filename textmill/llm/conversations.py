"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar of roles accepts an optional system turn and then user and assistant by
turns.  Error productions delete a row, give it another role, or insert an empty one.  All
rules begin with their nonterminal, so every item starts where its conversation starts and
a chart column needs one item for each nonterminal: the least (cost, audit) of completing
it there.  The completed Goal of the last column yields the repair.

Rows of a conversation stream through one task in order (the digest that is asked for is
one SHA-256 over the repaired text, which has no other form).  What the task holds is the
rows on which the column's items still disagree: a prefix that all share is let go, and an
item that costs so much more than another that it can't win is dropped.  Rows that must be
deleted change no order among items; a run of them is held as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textmill.llm.runtime import dealt, map_batches

#: head: (nonterminal, role initial); the initial is None where the head is the nonterminal alone.
GRAMMAR = (
    ("Lead", ("Start", "s")),
    ("Ask", ("Start", "u")),
    ("Ask", ("Lead", "u")),
    ("Ask", ("Turns", "u")),
    ("Turns", ("Ask", "a")),
    ("Goal", ("Start", None)),
    ("Goal", ("Turns", None)),
)
#: Error productions: costs, and the roles that a row may be given or that may be inserted.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: An item that costs more than this above another loses: the other can do all that is to come at two inserts and a deletion more.
SLACK = 2 * INSERT + DELETE
#: Pairs of role initials that may stand beside each other.
LAWFUL = {"su", "ua", "au"}
#: Letters on which items disagree before a shared prefix is looked for.
PENDING = 32

_WAITING = {x: tuple((head, t) for head, (of, t) in GRAMMAR if of == x and t) for x in ("Start", "Lead", "Ask", "Turns")}
_INSERTS = {x: tuple((head, t) for head, t in rules if t in ROLES) for x, rules in _WAITING.items()}
_GOAL = tuple(of for head, (of, _) in GRAMMAR if head == "Goal")

_EDITS = "place long, edit string, n long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SPACE = " \t\n\x0b\x0c\r"


def _offer(column: dict, head: str, value: tuple) -> bool:
    if head in column and column[head] <= value:
        return False
    column[head] = value
    return True


class Chart:
    """The last column of one conversation's chart, and the rows that its items have not agreed on.

    An item is (cost, audit, roles): a letter for each edit since the shared prefix, and
    the initial of the role that it gives, - for none.  Two items never differ by a proper
    prefix at equal cost, so the least of them stays least whatever follows.
    """

    def __init__(self):
        self.column = {"Start": (0, "", "")}
        self.insert()
        self.rows: list[tuple] = []
        self.run = 0
        self.limit = PENDING

    def insert(self) -> None:
        """Complete what inserts allow in this column; each costs, so this ends."""
        todo = list(self.column)
        for x in todo:
            cost, audit, roles = self.column[x]
            for head, t in _INSERTS[x]:
                if _offer(self.column, head, (cost + INSERT, audit + "I", roles + t)):
                    todo.append(head)

    def must_go(self) -> None:
        """A row that is deleted in any case."""
        self.run += 1

    def _close_run(self) -> None:
        if self.run:
            self.column = {x: (cost + DELETE * self.run, audit + "D", roles + "-") for x, (cost, audit, roles) in self.column.items()}
            self.rows.append((self.run, None, None))
            self.run = 0
            self.insert()

    def scan(self, role: str, text: str, truncated: bool) -> None:
        """The next column, for a row that may stay."""
        self._close_run()
        self.rows.append((1, role, text))
        more, initial, column = TRUNCATED * truncated, role[:1], {}
        for x, (cost, audit, roles) in self.column.items():
            _offer(column, x, (cost + DELETE, audit + "D", roles + "-"))
            for head, t in _WAITING[x]:
                if t == initial:
                    _offer(column, head, (cost + more, audit + "K", roles + t))
                if t in ROLES:
                    _offer(column, head, (cost + REROLE + more, audit + "R", roles + t))
        self.column = column
        self.insert()
        least = min(v[0] for v in self.column.values())
        self.column = {x: v for x, v in self.column.items() if v[0] <= least + SLACK}

    def agreed(self) -> list[tuple]:
        """Edits (letter, rows, role, text) that all items share, once enough has gathered."""
        if len(self.rows) < self.limit:
            return []
        items = list(self.column.values())
        k = min(len(commonprefix([v[1] for v in items])), len(commonprefix([v[2] for v in items])))
        found = self._let_go(items[0][1][:k], items[0][2][:k])
        self.column = {x: (cost, audit[k:], roles[k:]) for x, (cost, audit, roles) in self.column.items()}
        self.limit = max(PENDING, 2 * len(self.rows))
        return found

    def _let_go(self, audit: str, roles: str) -> list[tuple]:
        found, i = [], 0
        for letter, t in zip(audit, roles, strict=True):
            if letter == "I":
                found.append(("I", 1, ROLES[t], ""))
                continue
            n, role, text = self.rows[i]
            i += 1
            found.append((letter, n, None, None) if letter == "D" else (letter, n, ROLES[t] if letter == "R" else role, text))
        del self.rows[:i]
        return found

    def goal(self) -> tuple[int, list[tuple]]:
        """Cost of the completed Goal, and the edits that were not told before."""
        self._close_run()
        cost, audit, roles = min(self.column[x] for x in _GOAL if x in self.column)
        return cost, self._let_go(audit, roles)


class Conversation:
    """Counts and chart of one conversation."""

    def __init__(self):
        self.chart, self.place = Chart(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.turns, self.first, self.last = 0, None, None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LAWFUL:
            self.illegal += 1
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        if fault in ("blank", "duplicate"):
            self.chart.must_go()
        else:
            self.chart.scan(role, text, fault == "truncated")

    def _told(self, edits: list[tuple]) -> list[tuple]:
        found = [(self.place + i, *e, None, None, None, None, None, None) for i, e in enumerate(edits)]
        self.place += len(edits)
        return found

    def agreed(self) -> list[tuple]:
        return self._told(self.chart.agreed())

    def closed(self) -> list[tuple]:
        cost, edits = self.chart.goal()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        found = self._told(edits)
        return [*found, (self.place, None, 0, None, None, gaps, *self.faults.values(), self.illegal, cost)]


def _batch(keys: list, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [keys, *zip(*rows, strict=True)] if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str, key: pa.DataType) -> pa.Schema:
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([("conv_id", key), *[(n, types[t]) for n, t in (c.split() for c in ddl.split(", "))]])


def faulty(conversations: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text, and gone where a row is none) with their first fault, all rows of a conversation in one partition and in order.

    Order: turn, nulls first; rows of one turn by role and text.  Null roles and texts are one space.
    """
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    role, text = [F.when(~gone, F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")]
    rows = dealt(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, gone.alias("gone")), "conv_id")
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    # of rows that are equal in all, only the first is no duplicate, so it has to come first
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(bare == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.withColumn("nth", nth).withColumn("fault", F.when(~F.col("gone"), fault)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")


def repair(conversations: DataFrame) -> DataFrame:
    """Edits of every conversation, in order within each partition.

    conversations: conv_id, turn, role, text; a boolean column gone may mark rows that
    only name their conversation.  Faults: blank (nothing but white space), duplicate (role
    and text stood earlier), truncated (the last character is none of . ! ?); blank and
    duplicate rows must go.  Returns for each edit conv_id, place, edit (K, R, D, I), n (the
    rows it covers: 1, or a run of rows that must go), role and text (as repaired; null if
    deleted); and for each conversation a last row, its edit null, with gaps, blank,
    duplicate, truncated, illegal and cost.  Of the cheapest repairs the one whose letters
    come first is taken.  A null conv_id is a conversation; null turns come first; null
    roles and texts are one space; a role that is empty can't be kept; no rows give no rows.
    """
    key = conversations.schema["conv_id"].dataType
    schema = StructType.fromDDL(f"conv_id {key.simpleString()}, {_EDITS}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, None
        for batch in batches:
            out = out or _arrow(_EDITS, batch.column("conv_id").type)
            keys, found = [], []
            for conv, turn, role, text, gone, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "fault")], strict=True):
                if open_ is None or conv != now:
                    if open_ is not None:
                        found += open_.closed()
                        keys += [now] * (len(found) - len(keys))
                    now, open_ = conv, Conversation()
                if not gone:
                    open_.add(turn, role, text, fault)
                    found += open_.agreed()
                    keys += [now] * (len(found) - len(keys))
            yield _batch(keys, found, out)
        if open_ is not None:
            found = open_.closed()
            yield _batch([now] * len(found), found, out)

    return faulty(conversations).transform(map_batches, parse, schema.simpleString()[len("struct<") : -1])


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit, role and text of the rows that repair() leaves or inserts."""
    return repair(conversations).where("edit in ('K', 'R', 'I')").select("conv_id", "place", "edit", "role", "text")


def digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of repair(): its counts, audit, and the digest of its repaired rows; reads edits in the order in which they come."""
    key = edits.schema["conv_id"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, first, out = [], hashlib.sha256(), True, None
        for batch in batches:
            out = out or _arrow(_DIGEST, batch.column("conv_id").type)
            keys, found = [], []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                conv, _, edit, n, role, text, *counts = row
                if edit is None:
                    keys.append(conv)
                    found.append((*counts, "".join(audit), digest.hexdigest()))
                    audit, digest, first = [], hashlib.sha256(), True
                    continue
                audit.append(edit * n)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield _batch(keys, found, out)

    schema = StructType.fromDDL(f"conv_id {key.simpleString()}, {_DIGEST}")
    return edits.transform(map_batches, fold, schema.simpleString()[len("struct<") : -1])


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, drawn by the CRC-32 of conv_id:turn, in place of those that real ones have: rows gone, emptied, without end marks, repeated, or of another role."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    drawn = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", (drawn == 0).alias("gone"), F.when(drawn == 4, "user").otherwise(role).alias("role"),
        F.when(drawn == 1, "").when(drawn == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(drawn == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")
