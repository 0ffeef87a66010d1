"""Width and height of images from their headers, without decoding: PNG, JPEG, BMP and WebP."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import list_images

#: JPEG markers of a frame header (start of frame), and those that stand alone.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
ALONE = frozenset((0x01, *range(0xD0, 0xD8)))


def _jpeg(data: bytes) -> tuple[int, int] | None:
    """From segment to segment by their lengths until the frame header; a scan or the end before it means none."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in FRAMES:
            return (int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])) if at + 9 <= len(data) else None
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind, low = data[12:16], lambda a, b: int.from_bytes(data[a:b], "little")
    if kind == b"VP8X" and len(data) >= 30:
        return low(24, 27) + 1, low(27, 30) + 1
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = low(21, 25)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        return low(26, 28) & 0x3FFF, low(28, 30) & 0x3FFF
    return None


def _bmp(data: bytes) -> tuple[int, int] | None:
    low = lambda a, b: int.from_bytes(data[a:b], "little", signed=True)
    if len(data) < 26:
        return None
    return (low(18, 20) & 0xFFFF, low(20, 22) & 0xFFFF) if low(14, 18) == 12 else (low(18, 22), abs(low(22, 26)))  # rows from the top have a negative height


def image_size(data: bytes | None) -> tuple[str, int, int] | None:
    """format, width, height; None if the bytes are cut off before them, of another format, or say 0."""
    if data is None:
        return None
    found: tuple[str, tuple[int, int] | None] = ("", None)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        found = "png", (int.from_bytes(data[16:20]), int.from_bytes(data[20:24]))
    elif data[:2] == b"\xff\xd8":
        found = "jpeg", _jpeg(data)
    elif data[:2] == b"BM":
        found = "bmp", _bmp(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        found = "webp", _webp(data)
    kind, size = found
    return (kind, *size) if size and min(size) > 0 else None


def with_sizes(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``format``, ``width`` and ``height``; null where the header cannot be read."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([image_size(x) or (None, None, None) for x in f], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    sizes = F.pandas_udf(run, "format string, width int, height int")
    return df.drop("format", "width", "height").withColumn("_size", sizes(content)).select("*", "_size.*").drop("_size")


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, format, width, height of the images in a folder."""
    return with_sizes(list_images(spark, folder, with_content=True)).drop("content")
