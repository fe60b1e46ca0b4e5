"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; the rank as a fraction of
the source's size orders all rows, so any run of that order has the sources in
proportion.  The order is cut into shards of equal counts.

No rank is taken over a whole source or the whole table in one task: rows are ranked
within small ranges of the hash (or of the fraction), and the counts of the ranges
before are added, which come from a small table of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.runtime import staged

#: Rows that a range of the hash should hold at most, and bounds of the ranges' number as powers of two.
RANGE_ROWS = 1 << 20
LEAST_BITS, MOST_BITS = 10, 20
#: Bits of the shuffling hash: 15 hex digits of an MD5, which fit a long.
HASH_BITS = 60


def range_bits_for(rows: int) -> int:
    """Ranges (as a power of two) that keep each near RANGE_ROWS or below."""
    return min(MOST_BITS, max(LEAST_BITS, (rows // RANGE_ROWS).bit_length()))


def interleave(
    df: DataFrame, *, key: str = "doc_id", ties: tuple[str, ...] = (), stratum: str = "source", shards: int = 16, seed: int = 42, range_bits: int | None = None
) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 in each shard) to every row of df.

    df is read several times: hand over a written table.  ties are further columns that
    enter the hash and the order, so that rows which share a key (or have none) spread.
    Nulls: a null stratum is a stratum of its own, and so is the empty string; null keys
    and ties are left out of what is hashed.  Rows equal in key and ties have equal hashes
    and stand beside each other in either order; each row has its own slot.  An empty
    table gives an empty result.  Shard counts differ by one at most, and each stratum's
    share of a shard differs from its share of the table by a few rows.  Columns of df
    keep their names, but a shard or slot column is replaced; df must not hold names that
    begin with ``__il_``.
    """
    bits = range_bits_for(df.count()) if range_bits is None else range_bits
    ranges = 1 << bits
    order = [F.col(f"`{c}`") for c in (key, *ties)]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in order]))
    ranked = df.withColumns({
        "__il_stratum": F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")),
        "__il_hash": F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"),
    }).withColumn("__il_range", F.shiftright("__il_hash", HASH_BITS - bits).cast("int"))
    counts = ranked.groupBy("__il_stratum", "__il_range").agg(F.count(F.lit(1)).alias("__il_n"))
    stratum_of = Window.partitionBy("__il_stratum")
    before = counts.select(
        F.col("__il_stratum").alias("__il_s"),
        F.col("__il_range").alias("__il_r"),
        F.coalesce(F.sum("__il_n").over(stratum_of.orderBy("__il_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__il_before"),
        F.sum("__il_n").over(stratum_of).alias("__il_size"),
    )
    within = Window.partitionBy("__il_stratum", "__il_range").orderBy("__il_hash", *order)
    ranked = (
        ranked.withColumn("__il_rank", F.row_number().over(within))
        .join(before, (F.col("__il_stratum") == F.col("__il_s")) & (F.col("__il_range") == F.col("__il_r")))
        .withColumn("__il_part", (F.col("__il_rank") + F.col("__il_before") - F.lit(0.5)) / F.col("__il_size"))
        .withColumn("__il_cut", F.least(F.floor(F.col("__il_part") * ranges), F.lit(ranges - 1)).cast("int"))
        .drop("__il_s", "__il_r", "__il_range", "__il_rank", "__il_before", "__il_size")
    )
    cuts = ranked.groupBy("__il_cut").agg(F.count(F.lit(1)).alias("__il_n"))
    # one row for each of at most `ranges` cuts
    ahead = cuts.select(
        F.col("__il_cut").alias("__il_c"),
        F.coalesce(F.sum("__il_n").over(Window.orderBy("__il_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__il_ahead"),
        F.sum("__il_n").over(Window.partitionBy(F.lit(1))).alias("__il_all"),
    )
    in_cut = Window.partitionBy("__il_cut").orderBy("__il_part", "__il_stratum", "__il_hash", *order)
    place = F.row_number().over(in_cut) - 1 + F.col("__il_ahead")
    placed = ranked.join(F.broadcast(ahead), F.col("__il_cut") == F.col("__il_c")).withColumn("__il_place", place)

    # shard s holds the places from ceil(s * all / shards) up to the next shard's first
    shard = F.expr(f"cast((__il_place * {shards}) div __il_all as int)")
    first = F.expr(f"(shard * __il_all + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", (F.col("__il_place") - first).cast("long"))
    return placed.drop(*[c for c in placed.columns if c.startswith("__il_")])


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Digest of a sharding of documents: sizes and checksums are taken in one scan and written, so texts are neither shuffled nor read again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave(staged(rows, "sharding-rows"), ties=("text_crc32", "size"), shards=shards, seed=seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
