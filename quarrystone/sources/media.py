"""Facts from the first bytes of media files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 16


def container(head: Column) -> Column:
    """``avi``, ``mp4`` or ``webm_or_mkv`` by the first twelve bytes, null for others."""
    h = F.hex(F.substring(head, 1, 12))
    return (
        F.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "41564920"), "avi")
        .when((F.length(h) >= 24) & (F.substring(h, 9, 8) == "66747970"), "mp4")
        .when(h.startswith("1A45DFA3"), "webm_or_mkv")
    )


def image_kind(head: Column) -> Column:
    """Image kind by magic bytes, null for others."""
    h = F.hex(F.substring(head, 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("424D"), "bmp")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    )


# fixed values: where the formats keep width, height and depth, and the channels of PNG colour types
_LAYOUTS = {
    "png": (16, [("w", ">u4"), ("h", ">u4"), ("bits", "u1"), ("colour", "u1")]),
    "gif": (6, [("w", "<u2"), ("h", "<u2")]),
    "bmp": (18, [("w", "<i4"), ("h", "<i4"), ("planes", "<u2"), ("bits", "<u2")]),
}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_FRAMES = [m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC)]
_BARE = [0x00, 0x01, *range(0xD0, 0xDA)]  # markers without a body


def _words(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fields of ``size`` bytes at the given places as rows."""
    return data[at[:, None] + np.arange(size)]


def _fixed(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str) -> np.ndarray:
    """``width, height, channels, bits`` of headers with fixed places; zeros where one is cut off or impossible."""
    place, layout = _LAYOUTS[kind]
    dtype = np.dtype(layout)
    out = np.zeros((len(start), 4), np.int64)
    whole = np.flatnonzero(end - start >= place + dtype.itemsize)
    f = _words(data, start[whole] + place, dtype.itemsize).copy().view(dtype)[:, 0]
    w, h = f["w"].astype(np.int64), np.abs(f["h"].astype(np.int64))
    if kind == "png":
        channels, bits = np.array([_CHANNELS.get(c, 0) for c in range(256)])[f["colour"]], f["bits"]
        channels = np.where((_words(data, start[whole] + 12, 4) == np.frombuffer(b"IHDR", np.uint8)).all(1), channels, 0)
    elif kind == "bmp":
        bits, channels = f["bits"], np.where(f["bits"] >= 32, 4, 3)
    else:
        bits, channels = np.full(len(w), 8), np.full(len(w), 3)
    good = (w > 0) & (h > 0) & (channels > 0) & (bits > 0)
    out[whole[good]] = np.c_[w, h, channels, bits][good]
    return out


def _extended(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """WebP with an extended header: sizes less one in three bytes."""
    out = np.zeros((len(start), 4), np.int64)
    whole = np.flatnonzero(end - start >= 30)
    whole = whole[(_words(data, start[whole] + 12, 4) == np.frombuffer(b"VP8X", np.uint8)).all(1)]
    size = _words(data, start[whole] + 24, 6).astype(np.int64).reshape(-1, 2, 3) @ (1 << np.array([0, 8, 16]))
    out[whole] = np.c_[size + 1, np.full((len(whole), 2), (4, 8))]
    return out


def _segments(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """JPEG: all files walk from segment to segment together until each has met its frame header."""
    out = np.zeros((len(start), 4), np.int64)
    marks = np.flatnonzero(data == 0xFF)
    at, live = start + 2, np.arange(len(start))
    while len(live):
        k = np.searchsorted(marks, at[live])
        at[live] = np.where(k < len(marks), marks[np.minimum(k, max(len(marks) - 1, 0))] if len(marks) else 0, end[live])
        live = live[at[live] + 9 < end[live]]
        mark = data[at[live] + 1]
        size = _words(data, at[live] + 2, 2).astype(np.int64) @ (256, 1)
        frame, bare, fill = np.isin(mark, _FRAMES), np.isin(mark, _BARE), mark == 0xFF
        found = live[frame & (size >= 8)]
        body = _words(data, at[found] + 4, 6).astype(np.int64)
        h, w = body[:, 1] * 256 + body[:, 2], body[:, 3] * 256 + body[:, 4]
        good = (w > 0) & (h > 0)
        out[found[good]] = np.c_[w, h, body[:, 5], body[:, 0]][good]
        at[live] += np.where(fill, 1, np.where(bare, 2, 2 + size))
        live = live[(bare | fill | (size >= 2)) & ~frame]
    return out


def image_headers(heads: pa.Array, kinds: list[str | None]) -> np.ndarray:
    """Width, height, channels and bits per sample from the heads of images of known kinds; zeros if unreadable."""
    heads = heads.cast(pa.large_binary()).fill_null(b"")
    n = len(heads)
    offsets = np.frombuffer(heads.buffers()[1], np.int64)[heads.offset : heads.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(heads.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    out = np.zeros((n, 4), np.int64)
    for kind in {k for k in kinds if k}:
        rows = np.array([i for i, k in enumerate(kinds) if k == kind])
        start, end = offsets[rows], offsets[rows + 1]
        read = {"jpeg": _segments, "webp": _extended}.get(kind)
        out[rows] = read(data, start, end) if read else _fixed(data, start, end, kind)
    return out


# fixed values: the first bytes of the kinds
_MAGIC = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM", "webp": b"RIFF"}


def image_header(head: bytes | None) -> tuple[int, int, int, int] | None:
    """``image_headers`` for a single image; None if unreadable."""
    kind = next((k for k, m in _MAGIC.items() if (head or b"").startswith(m)), None)
    facts = image_headers(pa.array([head], pa.binary()), [kind])[0]
    return tuple(facts.tolist()) if facts[0] else None


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        facts = image_headers(batch.column(1), batch.column(2).to_pylist())
        none = pa.array(facts[:, 0] == 0)
        cols = [pc.if_else(none, pa.scalar(None, pa.int32()), pa.array(facts[:, i].astype(np.int32))) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["path", "kind", "width", "height", "channels", "bits"])


def image_facts(heads: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, kind, width, height, channels, bits`` from image bytes; only the head goes to Python."""
    h = heads.select(F.col(path).alias("path"), F.substring(content, 1, HEAD_BYTES).alias("h"), image_kind(F.col(content)).alias("kind"))
    return h.mapInArrow(_headers, "path string, kind string, width int, height int, channels int, bits int")


def media_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts of all media files below a folder; containers of videos are named, their contents never guessed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    video = files.select(F.col("path"), container(F.col("content")).alias("container"))
    return image_facts(files).join(video, "path")
