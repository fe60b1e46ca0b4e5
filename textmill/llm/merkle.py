"""Merkle manifest of a table: one tree for each group, and one over the groups' roots.

Leaves are digests that Spark takes where the rows are read.  Leaves of a group are
numbered along sorted ranges, so no group is ordered in one task.  A block is a run of
leaves that starts at a multiple of a power of the fanout; it is held as a numpy matrix
of hex digests, and every level is the matrix reshaped to rows of FANOUT digests.  A
sibling's place follows from a node's number alone.  The roots of blocks are the leaves of
the next round, so a round leaves one node of each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.runtime import dealt, map_batches, staged

FANOUT = 8
#: A block holds FANOUT to this power leaves: 4,096.
BLOCK_LEVELS = 4
#: Bytes of a digest as lowercase hex.
HEX = 64

_ORDER = ("grp", "name", "id", "digest", "salt")
_NUMBERED = "grp string, name string, id long, digest string, other string, salt long, part int, seq long"
_TOPS = "grp string, idx long, digest string, n long"
_PATHS = "grp string, idx long, lefts array<string>, rights array<string>"
_PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """A field of a leaf: - for null, else its number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def levels_of(n: int) -> int:
    """Levels above n leaves: 0 for one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Block:
    """Levels of a block as matrices of hex digests: rows of HEX bytes, FANOUT of them under a node."""

    def __init__(self, leaves: np.ndarray, levels: int):
        self.levels = [np.ascontiguousarray(leaves)]
        for _ in range(levels):
            self.levels.append(self._above(self.levels[-1]))

    @staticmethod
    def _above(nodes: np.ndarray) -> np.ndarray:
        whole = len(nodes) // FANOUT
        runs = [r.tobytes() for r in nodes[: whole * FANOUT].reshape(whole, FANOUT * HEX)]
        if whole * FANOUT < len(nodes):
            runs.append(nodes[whole * FANOUT :].tobytes())
        return np.frombuffer(b"".join(map(sha256, runs)), dtype=np.uint8).reshape(-1, HEX)

    @property
    def top(self) -> bytes:
        return self.levels[-1].tobytes()

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """What stands left and right of leaf i's ancestors in their runs, level by level."""
        found = []
        for nodes in self.levels[:-1]:
            run = i - i % FANOUT
            found.append((nodes[run:i].tobytes(), nodes[i + 1 : run + FANOUT].tobytes()))
            i //= FANOUT
        return found


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root over a leaf's digest and what stands beside its ancestors."""
    for left, right in path:
        digest = sha256(left + digest + right)
    return digest


def _by_block(batches: Iterator[pa.RecordBatch], emit: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """emit of each block of rows that lie in order; what is held is one block and one batch."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        n = batch.num_rows
        keys = list(zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist(), strict=True))
        a = 0
        for b in range(n):
            if keys[b] == now:
                continue
            if b > a:
                held.append(batch.slice(a, b - a))
            if held:
                yield emit(pa.Table.from_batches(held))
            held, a, now = [], b, keys[b]
        if n > a:
            held.append(batch.slice(a))
    if held:
        yield emit(pa.Table.from_batches(held))


def _block(rows: pa.Table, most: int) -> Block:
    """The rows' block: it has as many levels as the whole tree of n leaves, up to `most`."""
    digests = "".join(rows.column("digest").to_pylist()).encode()
    return Block(np.frombuffer(digests, dtype=np.uint8).reshape(-1, HEX), min(most, levels_of(rows.column("n")[0].as_py())))


def _beside(rows: pa.Table) -> list[tuple[str, str]]:
    """What the first row has of the siblings above the block."""
    return list(zip(rows.column("lefts")[0].as_py(), rows.column("rights")[0].as_py(), strict=True))


def _tops(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: pa.Table) -> pa.RecordBatch:
        above = -(-rows.column("n")[0].as_py() // FANOUT**most)
        values = rows.column("grp")[0].as_py(), rows.column("block")[0].as_py(), _block(rows, most).top.decode(), above
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["grp", "idx", "digest", "n"])

    return _by_block(batches, emit)


def _paths(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: pa.Table) -> pa.RecordBatch:
        block, above = _block(rows, most), _beside(rows)
        paths = [block.path(i) for i in range(rows.num_rows)]
        sides = [pa.array([[p[s].decode() for p in path] + [a[s] for a in above] for path in paths], pa.list_(pa.string())) for s in (0, 1)]
        return pa.RecordBatch.from_arrays([rows.column("grp").combine_chunks(), rows.column("idx").combine_chunks(), *sides], names=["grp", "idx", "lefts", "rights"])

    return _by_block(batches, emit)


def _proofs(most: int, root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each block has no leaf, but what stands above it."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def emit(rows: pa.Table) -> pa.RecordBatch:
        above = [(a.encode(), b.encode()) for a, b in _beside(rows)]
        subroot = rows.column("subroot")[0].as_py()
        beyond = b"".join(a + b for a, b in above)
        rows = rows.slice(1)
        block, n = _block(rows, most), rows.num_rows
        proofs, folded = [], []
        for i, (own, other) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("other").to_pylist(), strict=True)):
            path = block.path(i)
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path) + beyond).hexdigest())
            folded.append(fold((other or own).encode(), path + above).decode())
        said = [pa.array([v] * n, pa.string()) for v in (subroot, root)] + [pa.array(v, pa.string()) for v in (proofs, folded)]
        return pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), rows.column("digest").combine_chunks(), *said, pa.array([f == root for f in folded], pa.bool_())], names=names)

    return _by_block(batches, emit)


def _in_blocks(nodes: DataFrame, most: int) -> DataFrame:
    """nodes with block, all of a block in one partition and in order, what has no digest first."""
    return dealt(nodes.withColumn("block", F.expr(f"idx div {FANOUT**most}")), "grp", "block").sortWithinPartitions("grp", "block", F.col("digest").isNotNull(), "idx")


def _climb(nodes: DataFrame, n: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Over nodes (grp, idx, digest, n), of which the largest tree has n: each tree's root (grp, top), and what stands beside each block's ancestors (grp, block, lefts, rights)."""
    tops = staged(_in_blocks(nodes, most).transform(map_batches, partial(_tops, most), _TOPS), "merkle-tops")
    if n <= FANOUT**most:
        none = F.array().cast("array<string>")
        return tops.select("grp", F.col("digest").alias("top")), tops.select("grp", F.col("idx").alias("block"), none.alias("lefts"), none.alias("rights"))
    roots, above = _climb(tops, -(-n // FANOUT**most), most)
    return roots, staged(_with_paths(tops, above, most).withColumnRenamed("idx", "block"), "merkle-paths")


def _with_paths(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """What stands beside each node's ancestors up to the root: in its block, and above that."""
    a = above.select(F.col("grp").alias("a_grp"), F.col("block").alias("a_block"), "lefts", "rights")
    rows = nodes.join(a, F.col("grp").eqNullSafe(F.col("a_grp")) & (F.expr(f"idx div {FANOUT**most}") == F.col("a_block")))
    return _in_blocks(rows.select("grp", "idx", "digest", "n", "lefts", "rights"), most).transform(map_batches, partial(_paths, most), _PATHS)


def _numbered(leaves: DataFrame) -> tuple[DataFrame, int]:
    """leaves (grp, name, id, digest, other) with idx, their place in grp by name, id and digest, and n, the size of grp; and the largest n."""

    def seq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, k = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for g in batch.column("grp").to_pylist():
                k = k + 1 if g == now else 0
                now = g
                places.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "seq"])

    # the salt, once written, deals out rows that are equal in all else
    rows = staged(leaves.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_ORDER).sortWithinPartitions(*_ORDER)
    rows = staged(ranged.select("grp", "name", "id", "digest", "other", "salt").transform(map_batches, seq, _NUMBERED), "merkle-numbered")
    # a row for each group of each range: no more than ranges and groups together
    counts = rows.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("own"))
    of = Window.partitionBy("grp")
    ahead = F.coalesce(F.sum("own").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = staged(counts.select(F.col("grp").alias("b_grp"), F.col("part").alias("b_part"), ahead.alias("before"), F.sum("own").over(of).alias("n")), "merkle-counts")
    placed = rows.join(before, F.col("grp").eqNullSafe(F.col("b_grp")) & (F.col("part") == F.col("b_part")))
    return placed.select("grp", "name", "id", "digest", "other", (F.col("seq") + F.col("before")).alias("idx"), "n"), before.agg(F.max("n")).first()[0] or 0


def manifest(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs of every row of leaves (grp string, id long, leaf string, other string).

    leaf is a row's digest, other that of what is to be proved in its place (null: leaf
    itself).  A group's leaves ascend by id, then by digest; groups ascend by name, null
    first.  Returns id, leaf, subroot (of the group's tree), root, proof_sha256 (over all
    siblings from the leaf to the root, left to right), folded_root (from other, or leaf,
    and the siblings) and verified.  Null ids come first; rows that repeat another are
    leaves of their own; a group of one leaf has that leaf as its root; no leaves give no
    rows.  A group may hold any share of the rows: a task holds one block of leaves.
    """
    most = block_levels
    none = F.lit(None).cast("string")
    nodes, n = _numbered(leaves.select(F.col("grp"), none.alias("name"), F.col("id").cast("long").alias("id"), F.col("leaf").alias("digest"), F.col("other")))
    nodes = staged(nodes.drop("name"), "merkle-nodes")
    subroots, above = _climb(nodes, n, most)
    # the tree over the groups: its leaves are their roots
    groups, k = _numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.lit(None).cast("long").alias("id"), F.col("top").alias("digest"), none.alias("other")))
    groups = staged(groups, "merkle-groups")
    tops, beside = _climb(groups.select("grp", "idx", "digest", "n"), k, most)
    root = tops.first()  # one row, or none if there are no leaves
    over = _with_paths(groups, beside, most).select(F.col("idx").alias("g_idx"), F.col("lefts").alias("g_lefts"), F.col("rights").alias("g_rights"))
    over = groups.join(over, F.col("idx") == F.col("g_idx")).select("name", F.col("digest").alias("subroot"), "g_lefts", "g_rights")
    heads = above.join(over, F.col("grp").eqNullSafe(F.col("name"))).select(
        "grp", (F.col("block") * FANOUT**most).alias("idx"), "subroot", F.concat("lefts", "g_lefts").alias("lefts"), F.concat("rights", "g_rights").alias("rights")
    )
    rows = nodes.unionByName(heads, allowMissingColumns=True)
    return _in_blocks(rows, most).transform(map_batches, partial(_proofs, most, root.top if root else ""), _PROOFS)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by language; every third (by CRC-32 of its id) is to be proved with its text in lower case (A-Z alone)."""
    texts = F.col("text"), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own, other = [leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t) for t in texts]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), own.alias("leaf"), F.when(tampered, other).alias("other"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of documents: null fields are told apart from empty ones, null languages are a tree of their own, null doc_ids are not tampered with; other columns do not count."""
    return manifest(document_leaves(docs)).withColumnRenamed("id", "doc_id")
