"""Connected components of a graph given as pairs, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.runtime import staged


def components(pairs: DataFrame, what: str = "components") -> DataFrame:
    """(node, component) for every node of pairs (a, b); component is the smallest node reachable.

    Every round, each node points at the smallest of itself and its neighbours, the
    pointers are followed to their ends, and the pairs move to the ends.  Pairs that have
    become loops or repeat others go, so rounds shrink fast and few are needed.  A node
    with any number of neighbours is aggregated map-side; nothing is gathered in lists.
    Null ends are left out; loops and repeated pairs do no harm; no pairs give no rows.
    """
    edges = staged(_tidy(pairs.select("a", "b")), what)
    labels = staged(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), what)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), what)
        moving = True
        while moving:
            ahead = pointers.select(F.col("a").alias("to"), F.col("to").alias("end"))
            step = staged(pointers.join(ahead, "to").select("a", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), what)
            moving = not step.where("moved").isEmpty()
            pointers = step.select("a", "to")
        at_a = pointers.select("a", F.col("to").alias("ra"))
        at_b = pointers.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        moved = edges.join(at_a, "a").join(at_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        labels = staged(
            labels.join(pointers.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")),
            what,
        )
        edges = staged(_tidy(moved), what)
    return labels


def _tidy(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a < b."""
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
