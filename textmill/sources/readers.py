"""Readers that give raw records, and parsers of external benchmarks.

A raw record has source_id, source_record_id, text, license, domain and register.
"""

from __future__ import annotations

import gzip
import html.parser
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Columns of the external benchmarks, what is left out of one, and the machine label of another.
RAID_COLUMNS = ("id", "adv_source_id", "source_id", "model", "decoding", "repetition_penalty", "attack", "domain", "title", "prompt", "generation")
MAGE_COLUMNS = ("text", "label", "src")
HC3_COLUMNS = ("id", "question", "human_answers", "chatgpt_answers", "source")
RAID_EXCLUDED = ("code", "czech", "german")
MAGE_MACHINE_LABEL = 0

JSONL = "id string, text string, license string, domain string, register string, date string"


def require_limit(limit: int | None) -> None:
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    require_limit(limit)
    return df if limit is None else df.limit(limit)


def scored_source(rows: DataFrame, source_id: str, domain: str, register: str, *, min_language_score: float = 0.0, min_score: int = 0, limit: int | None = None) -> DataFrame:
    """Records of a corpus that carries language, language_score and int_score; missing scores count as 0."""
    kept = rows.where((F.coalesce("language_score", F.lit(0.0)) >= min_language_score) & (F.coalesce("int_score", F.lit(0)) >= min_score))
    upstream = F.when(F.col("language").isNotNull(), F.struct("language", F.col("language_score").cast("double").alias("score")))
    found = kept.select(F.lit(source_id).alias("source_id"), F.col("id").alias("source_record_id"), "text", upstream.alias("upstream"), F.lit(domain).alias("domain"), F.lit(register).alias("register"))
    return _limited(found, limit)


def jsonl(spark: SparkSession, path: str, *, source_id: str = "local", license: str = "unknown", domain: str = "unknown", register: str = "unknown", limit: int | None = None) -> DataFrame:
    """JSON lines with id and text; rows may override license, domain and register.  Rows without an id get a hash of their text."""
    rows = spark.read.schema(JSONL).json(path)
    return _limited(
        rows.select(
            F.lit(source_id).alias("source_id"),
            F.coalesce("id", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("source_record_id"),
            "text",
            F.coalesce("license", F.lit(license)).alias("license"),
            F.coalesce("domain", F.lit(domain)).alias("domain"),
            F.coalesce("register", F.lit(register)).alias("register"),
            "date",
        ),
        limit,
    )


def text_files(spark: SparkSession, root: str, source_id: str, license: str, domain: str, register: str, *, strip_boilerplate: bool = False) -> DataFrame:
    """Every *.txt below root as a record named by its file's stem."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    text = without_boilerplate(F.col("value")) if strip_boilerplate else F.col("value")
    return files.select(F.lit(source_id).alias("source_id"), stem.alias("source_record_id"), text.alias("text"), F.lit(license).alias("license"), F.lit(domain).alias("domain"), F.lit(register).alias("register"))


def without_boilerplate(text: Column) -> Column:
    """What stands between the line of ``*** START OF`` and ``*** END OF``, where these are."""
    begun = F.regexp_replace(text, r"(?s)\A.*?\*\*\* START OF[^\n]*(\n|\z)", "")
    return F.trim(F.regexp_replace(begun, r"(?s)\*\*\* END OF.*\z", ""))


def _records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of the records of a (gzip, many-member) WARC file."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    stream = io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        body = stream.read(size)
        if len(body) != size:
            raise EOFError("record is shorter than its declared length")
        yield headers, body


def wet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text records of WET segments: path, source_record_id, url, date, language, text and error.

    A segment that cannot be read gives one row with its error and no records, so a run's
    report can name it; blank texts are left out.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "source_record_id", "url", "date", "language", "text", "error"]
        for part in batches:
            for path, content in zip(part["path"], part["content"], strict=True):
                out = []
                try:
                    for h, body in _records(content):
                        text = body.decode("utf-8", "replace")
                        if h.get("warc-type") == "conversion" and text.strip():
                            out.append((path, h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-identified-content-language"), text, None))
                except (EOFError, OSError, ValueError, zlib.error) as e:
                    out = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(rows, "path string, source_record_id string, url string, date string, language string, text string, error string")


class _Visible(html.parser.HTMLParser):
    """Text outside hidden elements.  An end tag closes the hidden elements that were opened within it and not closed, so one that stays open hides what its parent holds, not the rest of the page."""

    HIDDEN = {"script", "style", "nav", "header", "footer", "aside", "noscript"}
    #: Elements that are never closed, or whose end may be left out.
    LOOSE = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "p", "li", "dt", "dd", "option", "tr", "td", "th", "thead", "tbody", "tfoot", "colgroup", "rt", "rp"}

    def __init__(self, body: bool):
        super().__init__(convert_charrefs=True)
        self.open, self.hidden, self.body, self.parts = [], 0, body, []

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            # what was left open before it was head
            self.open, self.hidden, self.body = [], 0, True
        elif tag == "main" and self.hidden:
            # the page's content is no part of a header or menu that was left open
            self.open, self.hidden = [], 0
        if tag not in self.LOOSE:
            self.open.append(tag)
            self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.hidden -= last in self.HIDDEN
            self.hidden -= tag in self.HIDDEN

    def handle_data(self, data):
        if self.body and not self.hidden and data.strip():
            self.parts.append(data.strip())


_BODY = re.compile(r"<body[\s>/]", re.I)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text of HTML bodies, one line for each run of text."""

    def visible(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Visible(body=not _BODY.search(page))
        parser.feed(page)
        parser.close()
        return "\n".join(parser.parts)

    return pages.map(visible)


def require_columns(df: DataFrame, expected: tuple[str, ...], name: str) -> None:
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks {missing}; it has {sorted(df.columns)}")


def parse_raid(rows: DataFrame, *, excluded: tuple[str, ...] = RAID_EXCLUDED, attacks: bool = True) -> DataFrame:
    """doc_id, group_id (the base text), text, label (1: machine), benchmark, domain, model, attack."""
    require_columns(rows, RAID_COLUMNS, "RAID")
    attack = F.when(F.coalesce("attack", F.lit("")) == "", "none").otherwise(F.col("attack"))
    domain = F.lower(F.coalesce("domain", F.lit("")))
    kept = rows.where(~domain.isin(*excluded))
    kept = kept if attacks else kept.where(attack == "none")
    or_unknown = lambda c: F.when(c == "", "unknown").otherwise(c)
    return kept.select(
        F.col("id").cast("string").alias("doc_id"),
        F.coalesce(F.when(F.col("source_id") != "", F.col("source_id")), F.col("id")).cast("string").alias("group_id"),
        F.coalesce("generation", F.lit("")).alias("text"),
        F.when(F.col("model") == "human", 0).otherwise(1).alias("label"),
        F.lit("raid").alias("benchmark"),
        or_unknown(domain).alias("domain"),
        or_unknown(F.coalesce("model", F.lit(""))).alias("model"),
        attack.alias("attack"),
    )


def parse_mage(rows: DataFrame, *, machine_label: int = MAGE_MACHINE_LABEL, order: str = "row") -> DataFrame:
    """Rows named by their `order` column."""
    require_columns(rows, (*MAGE_COLUMNS, order), "MAGE")
    name = F.concat(F.lit("mage_"), F.col(order).cast("string"))
    return rows.select(
        name.alias("doc_id"), name.alias("group_id"), "text", (F.col("label").cast("int") == machine_label).cast("int").alias("label"),
        F.lit("mage").alias("benchmark"), F.lit("unknown").alias("domain"), F.coalesce("src", F.lit("unknown")).alias("model"), F.lit("none").alias("attack"),
    )


def parse_hc3(rows: DataFrame) -> DataFrame:
    """One row for each non-blank answer; its number counts blank ones too, and a question is a group."""
    require_columns(rows, HC3_COLUMNS, "HC3")
    group = F.concat(F.lit("hc3_q"), F.col("id").cast("string"))
    sides = []
    for column, kind, label in (("human_answers", "human", 0), ("chatgpt_answers", "chatgpt", 1)):
        each = rows.select(group.alias("group_id"), F.coalesce("source", F.lit("unknown")).alias("domain"), F.posexplode(column).alias("k", "answer"))
        sides.append(
            each.where(F.trim(F.coalesce("answer", F.lit(""))) != "").select(
                F.concat_ws("_", "group_id", F.lit(kind), F.col("k").cast("string")).alias("doc_id"), "group_id", F.trim("answer").alias("text"),
                F.lit(label).alias("label"), F.lit("hc3").alias("benchmark"), "domain", F.lit(kind).alias("model"), F.lit("none").alias("attack"),
            )
        )
    return sides[0].unionByName(sides[1])


def _sentences(text: Column | str) -> Column:
    # a bare F.trim would take the place as its second argument and strip its digits
    return F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?]) "), lambda s: F.trim(s))


def quotes(docs: DataFrame, *, least: int = 28, most: int = 240, limit: int = 8) -> DataFrame:
    """doc_id, place and quote: the first distinct (case aside) sentences of fitting length of each text."""
    each = docs.select("doc_id", F.posexplode(_sentences("text")).alias("at", "quote")).where(F.length("quote").between(least, most))
    first = each.groupBy("doc_id", F.lower("quote").alias("folded")).agg(F.min(F.struct("at", "quote")).alias("q"))
    # a text has at most a few thousand sentences, and its first `limit` are kept
    chosen = first.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("q")), 1, limit).alias("q"))
    return chosen.select("doc_id", F.posexplode("q").alias("place", "q")).select("doc_id", "place", "q.quote")


PARSED = "struct<chunks:array<struct<text:string,blocks:array<struct<page:int>>>>>"


def parsed_quotes(parsed: DataFrame, *, least: int = 28, most: int = 240, limit: int = 8) -> DataFrame:
    """doc_id, place, quote and page: as quotes(), of parsed documents (doc_id, parsed: JSON with chunks of text and blocks).

    Chunks follow each other; a sentence counts where it stands first, whatever the case.
    page is the first that a block of its chunk tells, else null.  JSON that does not
    parse, or has no chunks, gives no rows; chunks without text are left out.
    """
    page = F.get(F.filter(F.transform("c.blocks", lambda b: b["page"]), lambda p: p.isNotNull()), F.lit(0))
    chunks = parsed.select("doc_id", F.posexplode(F.from_json("parsed", PARSED)["chunks"]).alias("chunk", "c")).select("doc_id", "chunk", page.alias("page"), "c.text")
    each = chunks.select("doc_id", "chunk", "page", F.posexplode(_sentences("text")).alias("at", "quote")).where(F.length("quote").between(least, most))
    first = each.groupBy("doc_id", F.lower("quote").alias("folded")).agg(F.min(F.struct("chunk", "at", "quote", "page")).alias("q"))
    chosen = first.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("q")), 1, limit).alias("q"))
    return chosen.select("doc_id", F.posexplode("q").alias("place", "q")).select("doc_id", "place", "q.quote", "q.page")
