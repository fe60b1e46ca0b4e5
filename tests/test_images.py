"""Image containers and masks from hand-made bytes, whole and hostile."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.sources import images as I


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def tiff(order, main, capture=()):
    """A TIFF block of entries (tag, type, value)."""
    e = "<" if order == b"II" else ">"

    def directory(entries, at):
        head, tail = struct.pack(e + "H", len(entries)), b""
        free = at + 2 + 12 * len(entries) + 4
        for tag, kind, value in entries:
            if kind == 2:
                raw, n = value.encode() + b"\0", len(value) + 1
            elif kind == 5:
                raw, n = struct.pack(e + "II", *value), 1
            else:
                raw, n = struct.pack(e + {3: "H", 4: "I"}[kind], value), 1
            if len(raw) > 4:
                head += struct.pack(e + "HHII", tag, kind, n, free + len(tail))
                tail += raw
            else:
                head += struct.pack(e + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
        return head + struct.pack(e + "I", 0) + tail

    first = directory([*main, (34665, 4, 0)] if capture else main, 8)
    if capture:
        first = directory([*main, (34665, 4, 8 + len(first))], 8) + directory(capture, 8 + len(first))
    return order + struct.pack(e + "HI", 42, 8) + first


def table(quality):
    scale = 200 - 2 * quality if quality >= 50 else 5000 / quality
    values = [max(1, min(255, int((b * scale + 50) / 100))) for b in I.LUMA_Q50]
    return bytes(values[k] for k in I.ZIGZAG)


def jpeg(*parts, size=(640, 480)):
    frame = segment(0xC0, b"\x08" + struct.pack(">HH", size[1], size[0]) + b"\x03")
    return b"\xff\xd8" + b"".join(parts) + frame + segment(0xDA, b"\0" * 10) + b"\x12\x34\xff\xd9"


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(*parts, size=(30, 20)):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", *size) + b"\x08\x02\0\0\0") + b"".join(parts) + chunk(b"IDAT", b"x" * 50) + chunk(b"IEND", b"")


def riff(*parts):
    body = b"WEBP" + b"".join(n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for n, d in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


CAMERA = [(271, 2, "Maker"), (272, 2, "M1")]
SHOT = [(33434, 5, (1, 125)), (33437, 5, (28, 10)), (34855, 3, 200)]
FILES = {
    "camera": jpeg(segment(0xE1, b"Exif\0\0" + tiff(b"II", CAMERA, SHOT)), segment(0xDB, b"\0" + table(90) + b"\x01" + table(90))),
    "big_endian": jpeg(segment(0xE1, b"Exif\0\0" + tiff(b"MM", [(305, 2, "Firefly editor"), (274, 3, 6)])), b"\xff\xff", segment(0xDB, b"\0" + bytes(range(1, 65)))),
    "png": png(chunk(b"tEXt", b"parameters\0a cat, Sampler: x"), chunk(b"eXIf", tiff(b"II", [(272, 2, "P")]))),
    "webp": riff((b"VP8X", b"\x08\0\0\0" + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")), (b"EXIF", tiff(b"II", CAMERA)), (b"odd ", b"abc"), (b"XMP ", b"TrainedAlgorithmicMedia")),
    "lossless": riff((b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + b"\0" * 5)),
    "gif": b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0" * 20,
    "c2pa": jpeg(segment(0xEB, b"JP\0\1jumbc2pa")),
    "cut": jpeg(segment(0xE1, b"Exif\0\0" + tiff(b"II", CAMERA)))[:20],
    "lying": b"\xff\xd8" + b"\xff\xe1\xff\xff" + b"Exif\0\0",
    "zero": b"\xff\xd8\xff\xe1\x00\x00" + b"\xff" * 30,
    "huge_chunk": b"\x89PNG\r\n\x1a\n" + b"\xff\xff\xff\xffIHDR" + b"\0" * 8,
    "bad_ifd": jpeg(segment(0xE1, b"Exif\0\0II*\0\xff\xff\xff\x7f")),
    "many_entries": jpeg(segment(0xE1, b"Exif\0\0II*\0\x08\0\0\0\xff\xff" + b"\x0f\x01\x02\0\xff\xff\xff\xff\xff\xff\xff\xff")),
    "text": b"hello", "empty": b"", "none": None,
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "image_id string, content binary").repartition(2)


def test_parts_of_whole_and_broken_files(files):
    got = {}
    for r in I.parts(files).orderBy("image_id", "seq").collect():
        got.setdefault(r.image_id, []).append((r.kind, r.cut))
        assert r.payload is None or FILES[r.image_id][r.offset :].find(r.payload) >= 0
    assert [k for k, _ in got["camera"]] == ["FFE1", "FFDB", "FFC0", "FFDA"] and not any(c for _, c in got["camera"])
    assert [k for k, _ in got["big_endian"]] == ["FFE1", "FFDB", "FFC0", "FFDA"]
    assert [k for k, _ in got["png"]] == ["IHDR", "tEXt", "eXIf", "IDAT", "IEND"]
    assert [k for k, _ in got["webp"]] == ["VP8X", "EXIF", "odd ", "XMP "]
    assert got["cut"] == [("FFE1", True)] and got["lying"] == [("FFE1", True)] and got["huge_chunk"] == [("IHDR", True)]
    assert got["zero"][-1][1] and set(got) & {"text", "empty", "none", "gif"} == set()


def test_sizes(files):
    got = {r.image_id: (r.format, r.width, r.height, r.has_exif, r.upscaled) for r in I.described(files, I.parts(files)).collect()}
    assert len(got) == len(FILES)
    assert got["camera"] == ("JPEG", 640, 480, True, False) and got["png"] == ("PNG", 30, 20, True, True)
    assert got["webp"] == ("WEBP", 800, 600, True, False) and got["lossless"][:3] == ("WEBP", 100, 50) and got["gif"][:3] == ("GIF", 7, 9)
    assert got["cut"][:3] == ("JPEG", None, None) and got["text"] == got["none"] == (None, None, None, False, None)


def test_exif_and_camera(files):
    found = I.parts(files)
    got = {}
    for r in I.exif(found).collect():
        got.setdefault(r.image_id, {})[r.field] = r.value
    assert got == {
        "camera": {"camera_make": "Maker", "camera_model": "M1", "exposure_time": "0.008", "f_number": "2.8", "iso": "200"},
        "big_endian": {"software": "Firefly editor", "orientation": "6"}, "png": {"camera_model": "P"}, "webp": {"camera_make": "Maker", "camera_model": "M1"},
    }
    assert {r.image_id: r.value for r in I.camera_consistency(I.exif(found)).collect()} == {"camera": "consistent", "big_endian": "no camera fields", "png": "partial", "webp": "partial"}


@pytest.mark.parametrize("quality", [30, 50, 75, 90, 98])
def test_quality_of_scaled_tables(spark, quality):
    df = spark.createDataFrame([(1, jpeg(segment(0xDB, b"\0" + table(quality))))], "image_id long, content binary")
    got = I.compression(I.parts(df)).first()
    assert abs(got.quality - quality) <= 1


def test_tables(files):
    got = {r.image_id: (r.tables, r.quality, r.standard) for r in I.compression(I.parts(files)).collect()}
    assert set(got) == {"camera", "big_endian"} and got["camera"][0] == 2 and got["camera"][2] and not got["big_endian"][2]
    assert I.ZIGZAG[:10] == (0, 1, 8, 16, 9, 2, 3, 10, 17, 24) and I.ZIGZAG[-3:] == (55, 62, 63)


def test_findings(files):
    got = {(r.image_id, r.name): (r.status, r.value) for r in I.findings(files).collect()}
    assert len(got) == 6 * len(FILES)
    assert got["camera", "camera_consistency"] == ("present", "consistent") and got["camera", "ai_declaration"] == ("not_found", None)
    assert got["big_endian", "ai_declaration"] == ("high", "Adobe Firefly software string")
    assert got["png", "ai_declaration"] == ("high", "Stable Diffusion parameter block (parameters, sampler)")
    assert got["webp", "ai_declaration"][1] == "IPTC digitalSourceType: trained algorithmic media; IPTC digitalSourceType: algorithmic media"
    assert got["c2pa", "c2pa"][0] == "present" and got["camera", "c2pa"][0] == "not_found"
    assert got["png", "jpeg_tables"] == ("not_checked", None) and got["none", "file_type"] == ("not_checked", None) and got["cut", "jpeg_tables"] == ("not_found", None)


@pytest.mark.parametrize("shape, grid", [((8, 8), 4), ((7, 5), 3), ((3, 3), 5), ((14, 14), 14)])
def test_patches_match_numpy(spark, shape, grid):
    rng = np.random.default_rng(1)
    mask, logits = (rng.random(shape) < 0.5).astype(float), rng.normal(size=(grid, grid))
    edge = lambda n: [(k * n // grid, -(-(k + 1) * n // grid)) for k in range(grid)]
    want = np.array([[mask[a:b, c:d].mean() for c, d in edge(shape[1])] for a, b in edge(shape[0])])
    df = spark.createDataFrame([(mask.tolist(), logits.tolist())], "mask array<array<double>>, logits array<array<double>>")
    got = df.select(I.patch_fractions("mask", grid).alias("p"), I.patch_iou("logits", "mask", grid).alias("iou")).first()
    assert np.allclose(got.p, want)
    said, true = logits >= 0, want >= 0.5
    assert got.iou == pytest.approx((said & true).sum() / (said | true).sum() if (said | true).any() else 1.0)


def test_masks_without_patches(spark):
    df = spark.createDataFrame([([[0.0] * 4] * 4, [[-5.0] * 2] * 2, [[0, 200], [128, 127]])], "mask array<array<double>>, logits array<array<double>>, grey array<array<int>>")
    got = df.select(I.patch_iou("logits", "mask", 2).alias("iou"), I.mask_fraction("grey").alias("f"), I.mask_fraction(F.array().cast("array<array<int>>")).alias("none")).first()
    assert tuple(got) == (1.0, 0.5, None)
