"""TIFF images in NumPy: deflate strips out; strips of grey, RGB and RGBA samples in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framestride.functions.columns import base_name
from framestride.operators.kernels import to_uint8

# Fixed values of the format: tags, sizes of value types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, DEFLATE, DEFLATE_OLD = 1, 8, 32946
STRIP_BYTES = 1 << 16
IMAGE = "frame string, height int, width int, rgb binary, error string"
IMAGES = pa.schema([("frame", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())])


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """A little-endian TIFF of 8-bit samples (height x width, or x 3 or 4), deflated by strips."""
    image = to_uint8(image)
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, n = image.shape
    if h < 1 or w < 1 or n not in (1, 3, 4):
        raise ValueError(f"no image of shape {image.shape}")
    step = max(1, STRIP_BYTES // (w * n))
    strips = [zlib.compress(image[y : y + step].tobytes(), level) for y in range(0, h, step)]
    at = np.cumsum([8, *map(len, strips)]).tolist()
    tags = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * n), COMPRESSION: (3, [DEFLATE]), PHOTOMETRIC: (3, [1 if n == 1 else 2]), OFFSETS: (4, at[:-1]), SAMPLES: (3, [n]), STRIP_ROWS: (4, [step]), COUNTS: (4, list(map(len, strips))), PLANAR: (3, [1])}
    if n == 4:
        tags[338] = (3, [2])  # the fourth sample is alpha
    body = b"".join(strips)
    body += b"\0" * (len(body) % 2)
    place = 8 + len(body)
    extra, entries, beyond = b"", b"", place + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(packed) > 4:
            value = struct.pack("<I", beyond + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        else:
            value = packed.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + value
    return b"II*\0" + struct.pack("<I", place) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def _directory(data: bytes) -> tuple[str, dict[int, list[int]]]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            form = f"{order}{count}{TYPES[kind]}"
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = list(struct.unpack_from(form, data, where))
    return order, tags


def decode(data: bytes) -> np.ndarray:
    """Samples (height x width x channels) of a file's first image, whole numbers of 8 or 16 bits or floats of 32 and 64.

    What isn't read raises ``ValueError``: tiles, planes, palettes, other compressions, short strips.
    """
    try:
        order, tags = _directory(data)
        one = {k: v[0] for k, v in tags.items() if v}
        w, h, n = one[WIDTH], one[HEIGHT], one.get(SAMPLES, 1)
        bits, kind, how = set(tags.get(BITS, [1])), one.get(FORMAT, 1), one.get(COMPRESSION, NONE)
        dtype = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4", (64, 3): "f8"}.get((min(bits), kind))
        if len(bits) != 1 or dtype is None or one.get(PLANAR, 1) != 1 and n > 1 or one.get(PHOTOMETRIC, 1) not in (0, 1, 2) or OFFSETS not in tags or n not in (1, 2, 3, 4) or w < 1 or h < 1:
            raise ValueError("this kind of TIFF is not read")
        if how not in (NONE, DEFLATE, DEFLATE_OLD):
            raise ValueError(f"compression {how} is not read")
        dtype = np.dtype(order + dtype)
        step = min(one.get(STRIP_ROWS, h), h)
        rows = []
        for i, (at, size) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
            count = max(0, min(step, h - i * step)) * w * n
            raw = data[at : at + size]
            if how != NONE:
                # a strip has a known size, so no stream unpacks to more
                raw = zlib.decompressobj().decompress(raw, count * dtype.itemsize) if count else b""
            if len(raw) < count * dtype.itemsize:
                raise ValueError("a strip is too short")
            rows.append(np.frombuffer(raw, dtype, count).reshape(-1, w, n))
        image = np.concatenate(rows).astype(dtype.newbyteorder("="))
        if image.shape[0] != h:
            raise ValueError("strips are missing")
    except (struct.error, zlib.error, KeyError, MemoryError) as broken:
        raise ValueError(f"broken TIFF: {broken}") from broken
    if one.get(PREDICTOR, 1) == 2 and kind == 1:
        image = np.cumsum(image, axis=1, dtype=image.dtype)
    elif one.get(PREDICTOR, 1) != 1:
        raise ValueError("this predictor is not read")
    return image.max() - image if one.get(PHOTOMETRIC, 1) == 0 and kind != 1 else np.iinfo(image.dtype).max - image if one.get(PHOTOMETRIC, 1) == 0 else image


def decode_rgb(data: bytes) -> np.ndarray:
    """Three 8-bit channels: grey is repeated, alpha dropped, values beyond 0..255 cut (``kernels.to_uint8``)."""
    image = to_uint8(decode(data))
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """``frame, height, width, rgb, error`` of the TIFF files below a folder; an unreadable one has no pixels but an error.

    Spark's file scan leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path)
    return decode_column(files.select(base_name("path").alias("frame"), "content"))


def decode_column(files: DataFrame) -> DataFrame:
    """The same for rows ``frame, content``; null content is an error too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {"frame": b.column(0)[i].as_py(), "height": None, "width": None, "rgb": None, "error": None}
                try:
                    rgb = decode_rgb(b.column(1)[i].as_py() or b"")
                    row |= {"height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes()}
                except ValueError as broken:
                    row["error"] = str(broken)
                yield pa.RecordBatch.from_pylist([row], schema=IMAGES)

    return files.mapInArrow(run, IMAGE)
