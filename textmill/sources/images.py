"""Image files as bytes: containers, capture metadata, compression tables, declared origins and masks.

No pixel is decoded.  The parts of all files of an Arrow batch (JPEG segments, PNG chunks,
RIFF chunks) are walked in lockstep on the batch's one buffer: a step reads the next part
of every file at once.  What is read from the parts afterwards are Spark expressions and
small helpers over their payloads.  A damaged file has rows up to where it breaks, the last marked as cut.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a payload that are kept: what a JPEG segment can hold.
PAYLOAD = 1 << 16
_PARTS = "seq int, kind string, offset long, length long, cut boolean, payload binary"
#: Parts whose payloads are kept: frames, tables and metadata.
_KEPT = {*(f"FF{m:02X}" for m in (*range(0xC0, 0xD0), 0xDB, *range(0xE0, 0xF0), 0xFE)), "IHDR", "tEXt", "zTXt", "iTXt", "eXIf", "acTL", "VP8 ", "VP8L", "VP8X", "EXIF", "XMP ", "ANMF"}

# The tags of interest and what they are called.
TAGS = {
    271: "camera_make", 272: "camera_model", 274: "orientation", 305: "software", 306: "datetime",
    33434: "exposure_time", 33437: "f_number", 34855: "iso", 36867: "datetime_original", 37386: "focal_length",
}
CAPTURE = ("exposure_time", "f_number", "focal_length", "iso")
# The standard luminance table at quality 50, row by row, and the spread of ratios below which a table is a scaled one.
LUMA_Q50 = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
STANDARD_SPREAD = 0.35
# Bytes that a provenance manifest holds, and bytes by which software declares what it made, with their names.
PROVENANCE, PROVENANCE_BYTES, PROVENANCE_SEGMENT_BYTES = ("jumb", "c2pa", "urn:uuid:c2pa"), 4_000_000, 65_536
DECLARATIONS = {
    "trainedalgorithmicmedia": "IPTC digitalSourceType: trained algorithmic media", "compositewithtrainedalgorithmicmedia": "IPTC: composite with algorithmic media",
    "algorithmicmedia": "IPTC digitalSourceType: algorithmic media", "stable diffusion": "Stable Diffusion software string", "stablediffusion": "Stable Diffusion software string",
    "midjourney": "Midjourney software string", "dall-e": "DALL-E software string", "firefly": "Adobe Firefly software string", "imagen": "Google Imagen software string",
    "comfyui": "ComfyUI workflow marker", "automatic1111": "AUTOMATIC1111 marker", "invokeai": "InvokeAI marker", "novelai": "NovelAI marker",
}
PARAMETERS, DECLARED_BYTES = ("parameters", "negative prompt", "sampler", "cfg scale", "model hash"), 1_048_576


class _Files:
    """The files of a batch on one buffer; reads beyond a file's end give zeros and are told by `inside`."""

    def __init__(self, content: pa.Array):
        content = content.cast(pa.large_binary())
        _, offsets, data = content.buffers()
        edges = np.frombuffer(offsets, dtype=np.int64)[content.offset : content.offset + len(content) + 1]
        self.data = np.concatenate([np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
        self.start, self.end = edges[:-1], edges[1:]

    def number(self, at: np.ndarray, n: int, little: bool = False) -> np.ndarray:
        found = np.zeros(len(at), dtype=np.int64)
        for k in range(n):
            byte = self.data[np.minimum(at + (n - 1 - k if little else k), len(self.data) - 1)].astype(np.int64)
            found = found << 8 | byte
        return found

    def begins(self, magic: bytes, at: int = 0) -> np.ndarray:
        found = self.end - self.start >= at + len(magic)
        for k, byte in enumerate(magic):
            found &= self.data[np.minimum(self.start + at + k, len(self.data) - 1)] == byte
        return found

    def text(self, at: np.ndarray, n: int) -> list[str]:
        return [bytes(self.data[a : a + n]).decode("latin-1") for a in at]


#: A step over parts at places: names, first byte and length of the payload, the next place, whether the head was sound, and whether it is the last part.
_Step = Callable[[_Files, np.ndarray], tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _jpeg(files: _Files, at: np.ndarray):
    marker = files.number(at + 1, 1)
    bare = (marker == 0x01) | ((marker >= 0xD0) & (marker <= 0xD9)) | (marker == 0xFF)
    length = np.where(bare, 0, files.number(at + 2, 2) - 2)
    # a fill byte is no part: the walk goes on a byte further
    step = np.where(marker == 0xFF, 1, np.where(bare, 2, 4 + length))
    sound = (files.number(at, 1) == 0xFF) & (length >= 0) & (marker != 0)
    return [f"FF{m:02X}" for m in marker], at + np.where(bare, 2, 4), length, at + step, sound, (marker == 0xD9) | (marker == 0xDA)


def _png(files: _Files, at: np.ndarray):
    length, names = files.number(at, 4), files.text(at + 4, 4)
    sound = np.array([n.isascii() and n.isalpha() for n in names], dtype=bool)
    return names, at + 8, length, at + 12 + length, sound, np.array([n == "IEND" for n in names], dtype=bool)


def _riff(files: _Files, at: np.ndarray):
    length, names = files.number(at + 4, 4, little=True), files.text(at, 4)
    return names, at + 8, length, at + 8 + length + length % 2, np.array([n.isascii() and n.isprintable() for n in names], dtype=bool), np.zeros(len(at), dtype=bool)


#: Format: bytes at the start, where the first part is, the bytes of a part's head, and the step.
_WALKS: dict[str, tuple[bytes, int, int, _Step]] = {"JPEG": (b"\xff\xd8\xff", 2, 2, _jpeg), "PNG": (b"\x89PNG\r\n\x1a\n", 8, 8, _png), "WEBP": (b"RIFF", 12, 8, _riff)}


def _walked(files: _Files, magic: bytes, first: int, head: int, step: _Step) -> Iterator[tuple]:
    """(row, seq, kind, offset in the file, length, cut, first byte in the buffer) of all parts."""
    row = np.flatnonzero(files.begins(magic))
    at, seq = files.start[row] + first, 0
    while len(row):
        room = at + head <= files.end[row]
        names, begin, length, after, sound, last = step(files, at)
        whole = room & sound & (begin + length <= files.end[row])
        for k in np.flatnonzero((at < files.end[row]) | ~room):
            if at[k] >= files.end[row][k]:
                continue
            fill = names[k] == "FFFF" and whole[k]
            if not fill:
                yield row[k], seq, names[k] if sound[k] and room[k] else None, int(at[k] - files.start[row[k]]), int(length[k]), not bool(whole[k]), int(begin[k])
        on = whole & ~last
        row, at, seq = row[on], after[on], seq + 1


def parts(images: DataFrame, key: str = "image_id") -> DataFrame:
    """key, seq, kind, offset, length, cut and payload of each part of JPEG, PNG and WebP files, in order of seq.

    kind is the JPEG marker in hex, or the chunk's name; a JPEG is walked to its first scan.
    payload holds up to 64 KB of frames, tables and metadata, and is null for other parts.
    cut marks a part that is not whole or has no sound head; nothing follows it.  Other
    formats, null and empty files have no rows.  The cost is that of the heads, not of the
    pixels.
    """
    kind = images.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("content").is_valid())
            files, found = _Files(batch.column("content")), []
            for name, (magic, first, head, step) in _WALKS.items():
                for row, seq, part, offset, length, cut, begin in _walked(files, magic, first, head, step):
                    if name == "WEBP" and files.data[files.start[row] + 8 : files.start[row] + 12].tobytes() != b"WEBP":
                        continue
                    kept = part in _KEPT
                    stop = min(begin + min(length, PAYLOAD), files.end[row])
                    found.append((row, seq, part, offset, length, cut, files.data[begin : max(stop, begin)].tobytes() if kept else None))
            columns = list(zip(*found, strict=True)) if found else [()] * 7
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            keys = batch.column("key").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names=["key", *[c.split()[0] for c in _PARTS.split(", ")]])

    made = images.select(F.col(key).alias("key"), "content").mapInArrow(rows, f"key {kind}, {_PARTS}")
    return made.withColumnRenamed("key", key)


def number(data: Column, at: Column | int, n: int, little: Column | bool = False) -> Column:
    """n bytes of binary data from a place (from 0) as a number; null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    bytes_ = [F.hex(F.substring(data, (at + k + 1).cast("int"), F.lit(1))) for k in range(n)]
    little = little if isinstance(little, Column) else F.lit(little)
    digits = F.when(little, F.concat(*reversed(bytes_))).otherwise(F.concat(*bytes_))
    return F.when(F.length(digits) == 2 * n, F.conv(digits, 16, 10).cast("long"))


def file_format(content: Column) -> Column:
    """What the bytes say, whatever the file is called; null if they say nothing."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("474946383761") | head.startswith("474946383961"), "GIF")
        .when(head.startswith("52494646") & head.endswith("57454250"), "WEBP").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "TIFF").when(head.startswith("424D"), "BMP")
    )


def described(images: DataFrame, found: DataFrame, key: str = "image_id", least: int = 224) -> DataFrame:
    """key, format, width, height, bytes, has_exif and upscaled (the shorter side is under `least`) of every image; null where the bytes do not tell.

    found is parts(images): sizes come from frame headers.  One row for each row of images.
    """
    p = F.col("payload")
    frame = F.col("kind").rlike("^FFC[0-9A-F]$") & ~F.col("kind").isin("FFC4", "FFC8", "FFCC")
    lossless = number(p, 1, 4, True)
    sized = (
        F.when(frame, F.struct(number(p, 3, 2).alias("width"), number(p, 1, 2).alias("height")))
        .when(F.col("kind") == "IHDR", F.struct(number(p, 0, 4).alias("width"), number(p, 4, 4).alias("height")))
        .when(F.col("kind") == "VP8X", F.struct((number(p, 4, 3, True) + 1).alias("width"), (number(p, 7, 3, True) + 1).alias("height")))
        .when((F.col("kind") == "VP8L") & (number(p, 0, 1) == 0x2F), F.struct((lossless.bitwiseAND(F.lit(0x3FFF)) + 1).alias("width"), (F.shiftright(lossless, 14).bitwiseAND(F.lit(0x3FFF)) + 1).alias("height")))
        .when(F.col("kind") == "VP8 ", F.struct(number(p, 6, 2, True).bitwiseAND(F.lit(0x3FFF)).alias("width"), number(p, 8, 2, True).bitwiseAND(F.lit(0x3FFF)).alias("height")))
    )
    facts = found.groupBy(key).agg(F.min_by(sized, F.when(sized.isNotNull() & ~F.col("cut"), F.col("seq"))).alias("size"), F.max(_exif_block().isNotNull()).alias("has_exif")).withColumnRenamed(key, "__key")
    c = F.col("content")
    kind = file_format(c)
    rows = images.select(key, kind.alias("format"), F.octet_length(c).cast("long").alias("bytes"), F.when(kind == "GIF", F.struct(number(c, 6, 2, True).alias("width"), number(c, 8, 2, True).alias("height"))).when(kind == "BMP", F.struct(number(c, 18, 4, True).alias("width"), number(c, 22, 4, True).alias("height"))).alias("own"))
    size = F.coalesce("own", "size")
    joined = rows.join(facts, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(key, "format", size["width"].alias("width"), size["height"].alias("height"), "bytes", F.coalesce("has_exif", F.lit(False)).alias("has_exif"), (F.least(size["width"], size["height"]) < least).alias("upscaled"))


def _exif_block() -> Column:
    """The TIFF block of a part that has one."""
    p = F.col("payload")
    return (
        F.when((F.col("kind") == "FFE1") & (F.hex(F.substring(p, 1, 6)) == "457869660000"), F.substring(p, F.lit(7), F.length(p)))
        .when(F.col("kind") == "EXIF", F.when(F.hex(F.substring(p, 1, 6)) == "457869660000", F.substring(p, F.lit(7), F.length(p))).otherwise(p))
        .when(F.col("kind") == "eXIf", p)
    )


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(block: bytes, order: str, at: int) -> Iterator[tuple[int, str | int | float]]:
    """(tag, value) of a directory's entries, as far as the bytes go."""
    if at + 2 > len(block):
        return
    (n,) = struct.unpack_from(order + "H", block, at)
    for e in range(at + 2, min(at + 2 + 12 * n, len(block) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", block, e)
        size = _SIZES.get(kind, 0) * count
        place = e + 8 if size <= 4 else struct.unpack_from(order + "I", block, e + 8)[0]
        if not size or place + size > len(block):
            continue
        if kind == 2:
            yield tag, block[place : place + count].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (3, 4):
            yield tag, struct.unpack_from(order + {3: "H", 4: "I"}[kind], block, place)[0]
        elif kind == 5 and (ratio := struct.unpack_from(order + "II", block, place))[1]:
            yield tag, ratio[0] / ratio[1]


def _tags(block: bytes) -> dict[str, str]:
    """Fields of a TIFF block, those of the main directory before those of the capture directory."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if not order or len(block) < 8:
        return {}
    main = list(_directory(block, order, struct.unpack_from(order + "I", block, 4)[0]))
    further = [x for tag, at in main if tag == 34665 and isinstance(at, int) for x in _directory(block, order, at)]
    return {TAGS[tag]: str(v) for tag, v in reversed(main + further) if tag in TAGS and str(v)}


def exif(found: DataFrame, key: str = "image_id") -> DataFrame:
    """key, field and value (text) of the capture metadata in parts(): the tags of TAGS, from the main and the capture directory.

    Directories are read as far as their bytes go: entries beyond the end, of unknown type
    or without a value are left out.  Of a field told twice the main directory's, and that
    of the first block, counts.
    """

    @F.udf("map<string,string>", useArrow=True)
    def fields(block):
        return None if block is None else _tags(bytes(block))

    blocks = found.withColumn("block", _exif_block()).where("block is not null and not cut")
    told = blocks.select(key, "seq", F.explode(fields("block")).alias("field", "value"))
    return told.groupBy(key, "field").agg(F.min_by("value", F.struct("seq", "value")).alias("value"))


def camera_consistency(fields: DataFrame, key: str = "image_id") -> DataFrame:
    """key and value of each image with fields of exif(): consistent (a body and three capture fields or more), partial (a body or any), or no camera fields."""
    of = fields.groupBy(key).agg(F.max(F.col("field").isin("camera_make", "camera_model")).alias("body"), F.count(F.when(F.col("field").isin(*CAPTURE), 1)).alias("capture"))
    value = F.when(F.col("body") & (F.col("capture") >= 3), "consistent").when(F.col("body") | (F.col("capture") > 0), "partial").otherwise("no camera fields")
    return of.select(key, value.alias("value"))


#: Places of a table's entries, row by row, in the zigzag order in which a file holds them: along diagonals, up and down by turns.
ZIGZAG = tuple(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _tables(payload: bytes) -> list[tuple[int, list[float] | None]]:
    """(number, ratios of its entries to the standard ones) of the tables of a segment: 64 entries of one byte or two each, after a byte of its own."""
    found, at = [], 0
    while at < len(payload):
        wide, name = payload[at] >> 4, payload[at] & 15
        size = 128 if wide else 64
        if at + 1 + size > len(payload):
            break
        entries = np.frombuffer(payload, dtype=">u2" if wide else np.uint8, count=64, offset=at + 1)
        found.append((name, (entries / np.array(LUMA_Q50)[list(ZIGZAG)]).tolist()))
        at += 1 + size
    return found


def compression(found: DataFrame, key: str = "image_id") -> DataFrame:
    """key, tables, quality (1 to 100, by the standard table's scaling) and standard (a scaled standard table) of JPEG files with a luminance table; a table that is cut is none."""

    @F.udf("array<struct<id:int,r:array<double>>>", useArrow=True)
    def tables(payload):
        return _tables(bytes(payload))

    rows = found.where("kind = 'FFDB' and not cut").select(key, "seq", F.posexplode(tables("payload")).alias("nth", "q"))
    # a later table of the same number takes the place of an earlier one
    luma = rows.groupBy(key).agg(F.countDistinct("q.id").cast("int").alias("tables"), F.max_by("q.r", F.when(F.col("q.id") == 0, F.struct("seq", "nth"))).alias("r")).where("r is not null")
    scale = F.aggregate("r", F.lit(0.0), lambda n, x: n + x) / 64 * 100
    quality = F.greatest(F.lit(1), F.least(F.lit(100), F.bround(F.when(scale <= 100, (200 - scale) / 2).otherwise(5000 / scale)).cast("int")))
    return luma.select(key, "tables", quality.alias("quality"), (F.array_max("r") - F.array_min("r") < STANDARD_SPREAD).alias("standard"))


def declarations(images: DataFrame, key: str = "image_id") -> DataFrame:
    """key, provenance (a manifest's marks are in the file) and declared (what its metadata say it was made by) of every image; null files have neither.

    Bytes are looked at up to fixed bounds, where metadata stand.  Absence says nothing.
    """
    head = lambda n: F.lower(F.decode(F.substring("content", 1, n), "ISO-8859-1"))
    rows = images.select(key, "content", head(DECLARED_BYTES).alias("head"), head(PROVENANCE_BYTES).alias("long"))
    segment = F.instr(F.hex(F.substring("content", 1, PROVENANCE_SEGMENT_BYTES)), "FFEB") % 2 == 1
    marks = segment
    for m in PROVENANCE:
        marks = marks | F.contains("long", F.lit(m))
    said = F.array_compact(F.array(*[F.when(F.contains("head", F.lit(m)), name) for m, name in DECLARATIONS.items()]))
    keys = F.array_compact(F.array(*[F.when(F.contains("head", F.lit(m)), m) for m in PARAMETERS]))
    block = F.when(F.size(keys) >= 2, F.array(F.concat(F.lit("Stable Diffusion parameter block ("), F.array_join(F.slice(keys, 1, 3), ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.coalesce(marks, F.lit(False)).alias("provenance"), F.coalesce(F.concat(said, block), F.array().cast("array<string>")).alias("declared"))


def findings(images: DataFrame, key: str = "image_id") -> DataFrame:
    """key, name, status (present, medium, high, not_found, not_checked) and value of what the bytes of each image tell: file_type, exif, camera_consistency, c2pa, ai_declaration and jpeg_tables.

    A signal that a file's format or damage does not let one read is not_checked, never a reassuring default.
    """
    found = parts(images, key)
    fields = exif(found, key)
    rows = described(images, found, key)
    capture = fields.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", "value"))), ", ").alias("exif"))
    for name, side in (("exif", capture), ("camera", camera_consistency(fields, key).withColumnRenamed("value", "camera")), ("tables", compression(found, key)), ("declared", declarations(images, key).dropDuplicates([key]))):
        side = side.withColumnRenamed(key, f"__{name}")
        rows = rows.join(side, F.col(key).eqNullSafe(F.col(f"__{name}")), "left").drop(f"__{name}")
    known = F.col("format").isNotNull()
    finding = lambda name, status, value: F.struct(F.lit(name).alias("name"), status.alias("status"), value.cast("string").alias("value"))
    camera = F.when(F.col("camera") == "consistent", "present").when(F.col("camera") == "partial", "medium").when(F.col("camera").isNotNull(), "not_found").otherwise("not_checked")
    tables = F.when(F.col("format") != "JPEG", "not_checked").when(F.col("quality").isNotNull(), "present").when(known, "not_found").otherwise("not_checked")
    listed = F.array(
        finding("file_type", F.when(known, "present").otherwise("not_checked"), F.col("format")),
        finding("exif", F.when(F.col("exif").isNotNull(), "present").when(known, "not_found").otherwise("not_checked"), F.col("exif")),
        finding("camera_consistency", camera, F.col("camera")),
        finding("c2pa", F.when(F.col("provenance"), "present").otherwise("not_found"), F.when(F.col("provenance"), "manifest markers present")),
        finding("ai_declaration", F.when(F.size("declared") > 0, "high").otherwise("not_found"), F.nullif(F.array_join("declared", "; "), F.lit(""))),
        finding("jpeg_tables", tables, F.when(F.col("format") == "JPEG", F.concat(F.lit("quality "), F.col("quality"), F.when(F.col("standard"), ", standard").otherwise(", custom")))),
    )
    return rows.select(key, F.explode(listed).alias("f")).select(key, "f.*")


def mask_fraction(mask: Column | str) -> Column:
    """Share of a grey mask's values (0 to 255, rows of values) above 127; null without values."""
    flat = F.flatten(mask)
    return F.size(F.filter(flat, lambda v: v > 127)) / F.nullif(F.size(flat), F.lit(0))


def patch_fractions(mask: Column | str, grid: int) -> Column:
    """Mean of a mask (rows of 0 to 1) in each of grid x grid patches, which reach from the floor to the ceiling of even shares, as adaptive average pooling has them."""
    m = F.col(mask) if isinstance(mask, str) else mask

    def cut(values: Column, k: Column) -> Column:
        n = F.size(values)
        low = F.floor(k * n / grid).cast("int")
        return F.slice(values, low + 1, F.ceil((k + 1) * n / grid).cast("int") - low)

    places = F.sequence(F.lit(0), F.lit(grid - 1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda n, v: n + v) / F.size(a)
    patch = lambda i, j: mean(F.flatten(F.transform(cut(m, i), lambda row: cut(row.cast("array<double>"), j))))
    return F.transform(places, lambda i: F.transform(places, lambda j: patch(i, j)))


def patch_iou(logits: Column | str, mask: Column | str, grid: int, threshold: float = 0.5) -> Column:
    """Overlap of the patches that a head marks (the logistic of its logits is at least threshold) and those that the mask covers by half or more; 1 if neither has any."""
    said = F.transform(F.flatten(logits), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) >= threshold)
    true = F.transform(F.flatten(patch_fractions(mask, grid)), lambda x: x >= 0.5)
    count = lambda both: F.aggregate(F.zip_with(said, true, lambda a, b: F.when(a & b if both else a | b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(count(False) == 0, F.lit(1.0)).otherwise(count(True) / count(False))
