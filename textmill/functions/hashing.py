"""Hash-based columns: content hashes, groups, splits, shards, salted ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default salt of splits; a corpus that was split under another one names it.
SPLIT_SALT = "split-v1"
# Shares of splits in 10,000.
TRAIN_BELOW, VAL_BELOW, SPLIT_RANGE = 8_000, 9_000, 10_000


def sha256(value: Column | str) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2((F.col(value) if isinstance(value, str) else value).cast("string"), 256)


def leading_number(hex_digest: Column, digits: int = 8) -> Column:
    """The number that the first hex digits stand for (15 at most)."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long")


def salted(value: Column | str, salt: str, joiner: str = "|") -> Column:
    """Hex SHA-256 of value, joiner and salt."""
    v = F.col(value) if isinstance(value, str) else value
    return sha256(F.concat(v.cast("string"), F.lit(joiner + salt)))


def ranked(value: Column | str, salt: str) -> Column:
    """Hex SHA-256 of salt, a colon and value: an order that does not depend on where rows stand."""
    v = F.col(value) if isinstance(value, str) else value
    return sha256(F.concat(F.lit(f"{salt}:"), v.cast("string")))


def group_id(doc_id: Column | str) -> Column:
    return F.concat(F.lit("grp_"), (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))


def split_of(group: Column | str, salt: str = SPLIT_SALT) -> Column:
    """train, val or test, by the group alone."""
    place = leading_number(salted(group, salt, joiner="")) % SPLIT_RANGE
    return F.when(place < TRAIN_BELOW, "train").when(place < VAL_BELOW, "val").otherwise("test")


def shard_of(content_sha256: Column | str, shards: int) -> Column:
    digest = F.col(content_sha256) if isinstance(content_sha256, str) else content_sha256
    return (leading_number(digest) % shards).cast("int")


def digest(value: Column | str, salt: str) -> Column:
    """48 bits of the salted hash."""
    return leading_number(salted(value, salt), 12)


def pick(options: list, number: Column) -> Column:
    """The option at number modulo the number of options; null for a null number, for which element_at gives 0 or an empty text."""
    return F.get(F.array(*[F.lit(o) for o in options]), (number % len(options)).cast("int"))


def bucket(value: Column, salt: str) -> Column:
    """A fraction of 0 to 1 from 32 bits of the salted hash."""
    return leading_number(salted(value, salt)) / F.lit(0xFFFFFFFF)


def arbitrary_label(image_id: Column | str, salt: str) -> Column:
    """0 or 1 without any meaning, for negative controls."""
    return (leading_number(ranked(image_id, salt)) % 2).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(value: Column) -> Column:
    """16 hex digits of a 64-bit number."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
