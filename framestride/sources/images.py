"""Images, registries and videos as DataFrames, and the sinks for their products."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.functions.columns import base_name, last_number, stem

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``video_id, file, path`` of a JSON object of videos; an empty one is an error."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<archivo_original:string,ruta:string>>")
    out = raw.select(F.explode(entries).alias("video_id", "v")).select("video_id", F.col("v.archivo_original").alias("file"), F.col("v.ruta").alias("path"))
    if not out.take(1):
        raise ValueError(f"no videos in {path}")
    return out


def find_video(registry: DataFrame, video_id: str, root: str) -> str:
    """The path of a video, relative ones from ``root``; unknown ids are an error that lists the known ones."""
    rows = registry.filter(F.col("video_id") == video_id).take(1)
    if not rows:
        # the registry is one JSON object, which a reader holds whole anyway
        known = ", ".join(r["video_id"] for r in registry.select("video_id").orderBy("video_id").collect())
        raise KeyError(f"unknown video {video_id}; known are: {known}")
    path = rows[0]["path"] or rows[0]["file"]
    return path if "://" in path or os.path.isabs(path) else f"{root.rstrip('/')}/{path}"


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, stem, number, length`` of the image files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}").load(path)
    return files.select("path", stem("path").alias("stem"), last_number(base_name("path")).alias("number"), "length")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``frame, image, error``: Spark's image struct (rows of BGR bytes) of each file; an unreadable one has no image but an error."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    bad = F.col("image.nChannels") < 1
    return images.select(base_name("image.origin").alias("frame"), F.when(~bad, F.col("image")).alias("image"), F.when(bad, F.lit("not a readable image")).alias("error"))


#: From the bytes of a video to (index, RGB image) of its frames.
Decoder = Callable[[bytes], Iterator[tuple[int, np.ndarray]]]
FRAME = "video string, idx long, height int, width int, rgb binary"


def decode_videos(spark: SparkSession, path: str, decoder: Decoder, wanted: DataFrame | None = None) -> DataFrame:
    """Frames of the videos under a path by a pluggable decoder; only ``wanted`` (``video, source_idx``) if given.

    No codec comes with this library. A video is one row, so one task reads it
    in order, once.
    """
    kind = pa.schema([("video", pa.string()), ("idx", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, rgb in decoder(content):
                    yield pa.RecordBatch.from_pylist([{"video": video, "idx": i, "height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.astype(np.uint8).tobytes()}], schema=kind)

    files = spark.read.format("binaryFile").load(path)
    frames = files.select(stem("path").alias("video"), "content").mapInArrow(run, FRAME)
    if wanted is None:
        return frames
    return frames.join(wanted.select("video", F.col("source_idx").alias("idx")), ["video", "idx"], "left_semi")


def encode_png(rgb: np.ndarray, level: int = 3) -> bytes:
    """An 8-bit RGB PNG."""
    h, w = rgb.shape[:2]
    raw = np.zeros((h, 1 + 3 * w), dtype=np.uint8)
    raw[:, 1:] = rgb.reshape(h, 3 * w)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


#: Samples of a pixel for the colour types that are read: grey, RGB, grey and RGB with alpha.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Rows of 8-bit pixels (1 to 4 channels) of a PNG; palettes, other depths and interlaced ones are not read."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG header")
    packed, head, at = [], b"", 8
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("broken PNG: a chunk is damaged")
        at += 12 + n
        if name == b"IHDR":
            head = body
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    if len(head) != 13:
        raise ValueError("broken PNG: no size")
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or kind not in CHANNELS or interlaced:
        raise ValueError("this kind of PNG is not read")
    c = CHANNELS[kind]
    size = h * (1 + w * c)
    if not h or not w or size >= 1 << 31:
        raise ValueError("broken PNG: a size that no image has")
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), size)
    except zlib.error as broken:
        raise ValueError(f"broken PNG: {broken}") from broken
    if len(raw) < size:
        raise ValueError("broken PNG: rows are missing")
    lines = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * c)
    if not lines[:, 0].any():
        return lines[:, 1:].reshape(h, w, c)
    out = np.zeros((h + 1, w + 1, c), np.int64)  # with a row above and a pixel to the left
    for y in range(h):
        out[y + 1, 1:] = lines[y, 1:].reshape(w, c)
        _unfilter(int(lines[y, 0]), out[y], out[y + 1])
    return out[1:, 1:].astype(np.uint8)


def _unfilter(kind: int, above: np.ndarray, row: np.ndarray) -> None:
    """Undo a line's filter in place; the first pixel of both is the zero before the line."""
    if kind == 1:
        row[:] = np.cumsum(row, axis=0) & 255
    elif kind == 2:
        row += above
        row &= 255
    elif kind in (3, 4):
        for x in range(1, len(row)):
            a, b, c = row[x - 1], above[x], above[x - 1]
            if kind == 3:
                guess = (a + b) >> 1
            else:
                pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            row[x] = (row[x] + guess) & 255
    elif kind:
        raise ValueError(f"broken PNG: filter {kind}")


def encode_column(frames: DataFrame, level: int = 3) -> DataFrame:
    """``name, content``: the PNG of each of ``name, height, width, rgb``, for tables of many small images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = [encode_png(np.frombuffer(rgb, np.uint8).reshape(h, w, 3), level) for h, w, rgb in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.binary())], names=["name", "content"])

    return frames.select("name", "height", "width", "rgb").mapInArrow(run, "name string, content binary")


IMAGE = "frame string, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>, error string"
DECODED = pa.schema([
    ("frame", pa.string()), ("image", pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])), ("error", pa.string())])
#: Pixels after which a batch of decoded images is handed on.
BATCH_BYTES = 16 << 20


def decode_column(files: DataFrame) -> DataFrame:
    """What ``read_frames`` gives, of rows ``name, content`` (PNG); grey is one channel, alpha is dropped from grey alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                image, error = None, None
                try:
                    px = decode_png(content.as_py() or b"")
                    px = px[:, :, :1] if px.shape[2] == 2 else px if px.shape[2] == 1 else px[:, :, [2, 1, 0, 3][: px.shape[2]]]
                    h, w, n = px.shape
                    # the mode is OpenCV's: 8 bits of so many channels
                    image = {"origin": name, "height": h, "width": w, "nChannels": n, "mode": 8 * (n - 1), "data": px.tobytes()}
                    held += px.size
                except ValueError as broken:
                    error = str(broken)
                rows.append({"frame": name, "image": image, "error": error})
                if held >= BATCH_BYTES or len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=DECODED)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=DECODED)

    return files.select("name", "content").mapInArrow(run, IMAGE)


def write_frames(frames: DataFrame, where: str, level: int = 3) -> DataFrame:
    """Write ``name, height, width, rgb`` as PNG files into a shared folder; returns ``name, path, bytes``.

    A file is written under a name of its own and moved into place, so a task that
    runs twice leaves one whole file.
    """
    kind = pa.schema([("name", pa.string()), ("path", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(where) if "://" in where else (pafs.LocalFileSystem(), where)
        fs.create_dir(inner, recursive=True)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                data = encode_png(np.frombuffer(r["rgb"], dtype=np.uint8).reshape(r["height"], r["width"], 3), level)
                part = f"{inner}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(data)
                fs.move(part, f"{inner}/{r['name']}")
                rows.append({"name": r["name"], "path": f"{where}/{r['name']}", "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return frames.select("name", "height", "width", "rgb").mapInArrow(run, "name string, path string, bytes long")


def read_metrics(spark: SparkSession, path: str, aliases: dict[str, list[str]], least: int = 5) -> DataFrame:
    """A CSV of frame metrics: the first known column for each name, numbers where they are, rows with a frame name.

    Fewer than ``least`` rows with a finite residual are an error.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    plain = {c.removeprefix("﻿").strip(): c for c in raw.columns}
    chosen = {n: next((plain[a] for a in names if a in plain), None) for n, names in aliases.items()}
    if chosen.get("frame") is None:
        raise ValueError(f"no frame column among {raw.columns}")

    def number(c: str | None):
        v = F.col(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    frame = F.trim(F.col(f"`{chosen['frame']}`"))
    out = raw.select(frame.alias("frame"), *[number(c).alias(n) for n, c in chosen.items() if n != "frame"]).filter("frame IS NOT NULL AND frame <> ''")
    out = out.filter("residual IS NOT NULL") if "residual" in chosen else out
    if len(out.take(least)) < least:
        raise ValueError(f"fewer than {least} usable rows in {path}")
    return out.withColumn("number", last_number(stem("frame")))
