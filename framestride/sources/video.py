"""Raw video (Y4M) as a data source that several tasks read, by ranges of frames.

``register(spark)`` adds the format ``y4m``. Its options: ``path`` (a file, or a
folder read with all below it), ``rangeFrames`` (frames for a task, else as many
as make 64 MB) ``pixels`` (``false``: places of the frames alone, without
reading them), and ``videos`` (a JSON list), ``first`` and ``past`` (numbers of frames), which choose
files and frames before any pixel is read. ``frames_at`` decodes only wanted frames.
The choice is by options, not by ``pushFilters``: in Spark 4.1 filters pushed into a Python source stay with
its table, and a second filter on the same DataFrame then gives wrong rows.

A file is ``<video>.y4m`` or ``<video>@<first>.y4m`` for a video kept in pieces, the
piece's frames being numbered from ``first``. Frames are found by their size where
all have a bare header, else by a walk over the headers. A frame that is cut off or
has no header, and a file that can't be understood, is a row with an error.

This module imports nothing of the package, so that workers that plan a scan need not find it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLACE = "video string, idx long, file string, place long, mark int, height int, width int, space string, full boolean, fps_num int, fps_den int, error string"
FRAME = "video string, idx long, height int, width int, rgb binary, error string"
PLACES = pa.schema([
    ("video", pa.string()), ("idx", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("mark", pa.int32()), ("height", pa.int32()), ("width", pa.int32()),
    ("space", pa.string()), ("full", pa.bool_()), ("fps_num", pa.int32()), ("fps_den", pa.int32()), ("error", pa.string())])
FRAMES = pa.schema([("video", pa.string()), ("idx", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())])
# Fixed values of the format.
MAGIC, MARK = b"YUV4MPEG2", b"FRAME"
#: Chroma samples across and down for each colour space (None: grey).
SPACES = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}
TASK_BYTES = 64 << 20
#: Frames of a batch hold about so many bytes of pixels.
BATCH_BYTES = 16 << 20


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Clip:
    """What a file's header says, and where its first frame is."""

    video: str
    first: int
    file: str
    size: int
    begin: int = 0
    height: int = 0
    width: int = 0
    space: str = ""
    full: bool = False
    fps: tuple[int, int] = (0, 0)
    error: str | None = None

    @property
    def payload(self) -> int:
        return payload(self.height, self.width, self.space)


def payload(height: int, width: int, space: str) -> int:
    """Bytes of a frame without its header."""
    cut = SPACES[space]
    chroma = 0 if cut is None else 2 * (-(-width // cut[0])) * (-(-height // cut[1]))
    return height * width + chroma


def open_clip(fs: pafs.FileSystem, inner: str, size: int, shown: str) -> Clip:
    name = os.path.basename(inner).removesuffix(".y4m")
    piece = re.fullmatch(r"(.+)@(\d+)", name)
    clip = Clip(piece[1] if piece else name, int(piece[2]) if piece else 0, shown, size)
    with fs.open_input_file(inner) as f:
        line, end, _ = f.read(4096).partition(b"\n")
    fields = line.split(b" ")
    if fields[0] != MAGIC or not end:
        clip.error = "no Y4M header"
        return clip
    try:
        said = {x[:1].decode(): x[1:].decode() for x in fields[1:] if x[:1] != b"X"}
        clip.height, clip.width, clip.space, clip.begin = int(said["H"]), int(said["W"]), said.get("C", "420"), len(line) + 1
        num, den = said.get("F", "0:0").split(":")
        clip.fps, clip.full = (int(num), int(den)), b"XCOLORRANGE=FULL" in fields
    except (KeyError, ValueError, UnicodeDecodeError):
        clip.error = "header can't be understood"
        return clip
    if clip.space not in SPACES:
        clip.error = f"colour space {clip.space} is not read"
    elif clip.height < 1 or clip.width < 1:
        clip.error = "frames without pixels"
    return clip


def places(fs: pafs.FileSystem, clip: Clip) -> tuple[int, int] | list[tuple[int, int]]:
    """Where payloads are: (stride, number) where every frame has a bare header, else one by one with the header's length.

    A last frame that is cut off counts too; reading it gives the error.
    """
    stride = len(MARK) + 1 + clip.payload
    whole, rest = divmod(clip.size - clip.begin, stride)
    inner = storage(clip.file)[1]
    with fs.open_input_file(inner) as f:
        def bare(i: int) -> bool:
            f.seek(clip.begin + i * stride)
            return f.read(len(MARK) + 1) == MARK + b"\n"

        if rest == 0 and whole and bare(0) and bare(whole - 1):
            return stride, whole
        found, at = [], clip.begin
        while at < clip.size:
            f.seek(at)
            line, end, _ = f.read(512).partition(b"\n")
            if not line.startswith(MARK) or not end:
                found.append((at, 0))  # nothing behind it can be found
                break
            found.append((at + len(line) + 1, len(line) + 1))
            at = found[-1][0] + clip.payload
        return found


def to_rgb(raw: bytes, height: int, width: int, space: str, full: bool) -> np.ndarray:
    """RGB of a frame: BT.601, chroma repeated, half to even."""
    cut = SPACES[space]
    n = height * width
    y = np.frombuffer(raw, np.uint8, n).reshape(height, width).astype(np.float64)
    if not full:
        y = (y - 16) * (255 / 219)
    if cut is None:
        return np.repeat(np.clip(np.rint(y), 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    h, w = -(-height // cut[1]), -(-width // cut[0])
    scale = 1.0 if full else 255 / 224
    u, v = ((np.frombuffer(raw, np.uint8, h * w, n + i * h * w).reshape(h, w).astype(np.float64) - 128) * scale for i in (0, 1))
    u, v = (np.repeat(np.repeat(c, cut[1], axis=0), cut[0], axis=1)[:height, :width] for c in (u, v))
    rgb = np.stack([y + 1.402 * v, y - (0.114 * 1.772 * u + 0.299 * 1.402 * v) / 0.587, y + 1.772 * u], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


@dataclass
class Range(InputPartition):
    """Frames ``low .. high - 1`` of a clip, counted from its first."""

    clip: Clip
    low: int
    high: int
    stride: int
    found: list[tuple[int, int]]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.pixels = options.get("pixels", "true").lower() != "false"
        self.task_frames = int(options.get("rangeFrames", 0))
        self.videos = set(json.loads(options["videos"])) if "videos" in options else None
        self.low, self.high = int(options.get("first", 0)), int(options["past"]) if "past" in options else None
        self.chosen = "first" in options or "past" in options

    def partitions(self) -> list[InputPartition]:
        fs, inner = storage(self.path)
        info = fs.get_file_info(inner)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        out: list[InputPartition] = []
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.path.endswith(".y4m") and not f.base_name.startswith(".")), key=lambda f: f.path):
            clip = open_clip(fs, f.path, f.size, prefix + f.path)
            if self.videos is not None and clip.video not in self.videos:
                continue
            if clip.error:
                # no frame is known, so only a scan without a choice of frames shows it
                if not self.chosen:
                    out.append(Range(clip, 0, 0, 0, []))
                continue
            at = places(fs, clip)
            stride, n, found = (*at, []) if isinstance(at, tuple) else (0, len(at), at)
            low = max(0, self.low - clip.first)
            high = n if self.high is None else min(n, self.high - clip.first)
            step = self.task_frames or max(1, TASK_BYTES // clip.payload)
            for a in range(low, high, step):
                b = min(high, a + step)
                out.append(Range(clip, a, b, stride, found[a:b]))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        c = part.clip
        common = {"video": c.video, "file": c.file, "height": c.height, "width": c.width, "space": c.space, "full": c.full, "fps_num": c.fps[0], "fps_den": c.fps[1]}
        if c.error:
            rows = [{"video": c.video, "file": c.file, "error": c.error}]
        else:
            bare = len(MARK) + 1
            at = ((c.begin + i * part.stride + bare, bare) if part.stride else part.found[i - part.low] for i in range(part.low, part.high))
            rows = ({**common, "idx": i, "place": place, "mark": mark} for i, (place, mark) in enumerate(at, c.first + part.low))
        if self.pixels:
            yield from decode(rows)
            return
        held = []
        for r in rows:
            held.append(r)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema=PLACES)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=PLACES)


def decode(rows) -> Iterator[pa.RecordBatch]:
    """Frames at their places; a file stays open while rows name it."""
    held, size, name, handle = [], 0, None, None
    try:
        for r in rows:
            out = {"video": r["video"], "idx": r.get("idx"), "height": r.get("height"), "width": r.get("width"), "rgb": None, "error": r.get("error")}
            if out["error"] is None:
                if r["file"] != name:
                    if handle is not None:
                        handle.close()
                    fs, inner = storage(r["file"])
                    name, handle = r["file"], fs.open_input_file(inner)
                want = payload(r["height"], r["width"], r["space"])
                handle.seek(r["place"] - r["mark"])
                raw = handle.read(r["mark"] + want)
                if r["mark"] == 0 or raw[: len(MARK)] != MARK or raw[r["mark"] - 1 : r["mark"]] != b"\n":
                    out["error"] = "no frame header"
                elif len(raw) < r["mark"] + want:
                    out["error"] = "frame is cut off"
                else:
                    out["rgb"] = to_rgb(raw[r["mark"] :], r["height"], r["width"], r["space"], r["full"]).tobytes()
                    size += len(out["rgb"])
            held.append(out)
            if size >= BATCH_BYTES or len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema=FRAMES)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=FRAMES)
    finally:
        if handle is not None:
            handle.close()


class Y4M(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return PLACE if self.options.get("pixels", "true").lower() == "false" else FRAME

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("y4m")`` known to the session."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Y4M)


def _reader(spark: SparkSession, range_frames: int, videos: list[str] | None, first: int | None, past: int | None):
    register(spark)
    chosen = {"first": first, "past": past, "videos": None if videos is None else json.dumps(videos)}
    return spark.read.format("y4m").option("rangeFrames", range_frames).options(**{k: v for k, v in chosen.items() if v is not None})


def read_video(spark: SparkSession, path: str, range_frames: int = 0, videos: list[str] | None = None, first: int | None = None, past: int | None = None) -> DataFrame:
    """``video, idx, height, width, rgb, error`` of the frames below a path, or of those from ``first`` to before ``past`` of some ``videos``."""
    return _reader(spark, range_frames, videos, first, past).load(path)


def frame_places(spark: SparkSession, path: str, range_frames: int = 0, videos: list[str] | None = None, first: int | None = None, past: int | None = None) -> DataFrame:
    """The index of the same frames; no pixel is read."""
    return _reader(spark, range_frames, videos, first, past).option("pixels", "false").load(path)


def metadata(index: DataFrame) -> DataFrame:
    """``video, width, height, fps, total, seconds, space`` of each video of an index; null rates where the header has none."""
    fps = F.when(F.col("fps_den") > 0, F.col("fps_num") / F.col("fps_den"))
    one = index.filter("error IS NULL").groupBy("video").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max(fps).alias("fps"), F.count("idx").alias("total"), F.max("space").alias("space"))
    return one.select("video", "width", "height", "fps", "total", F.when(F.col("fps") > 0, F.col("total") / F.col("fps")).alias("seconds"), "space")


def frames_at(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames of ``wanted`` (``video, source_idx``, repeats count once) and no others: narrow rows meet, then each task reads its frames in order of place."""
    chosen = wanted.select("video", F.col("source_idx").alias("idx")).distinct()
    rows = index.join(chosen, ["video", "idx"], "left_semi").select(*index.columns).sortWithinPartitions("file", "place")
    return rows.mapInArrow(lambda batches: decode(r for b in batches for r in b.to_pylist()), FRAME)


def write_y4m(frames: DataFrame, where: str, height: int, width: int, fps: tuple[int, int] = (30, 1), piece: int = 65_536) -> DataFrame:
    """Write grey ``video, idx, grey`` (bytes, row by row) as pieces of so many frames; returns ``video, first, frames, path``.

    ``video`` must do as a file name, and ``idx`` must have no gaps. A piece streams from one task to a
    file of its own name and is moved into place whole, so a task that runs twice leaves one.
    """
    kind = pa.schema([("video", pa.string()), ("first", pa.int64()), ("frames", pa.int64()), ("path", pa.string())])
    head = MAGIC + f" W{width} H{height} F{fps[0]}:{fps[1]} Ip A1:1 Cmono XCOLORRANGE=FULL\n".encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = storage(where)
        fs.create_dir(inner, recursive=True)
        key, out, part, n = None, None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            final = f"{key[0]}@{key[1]:012d}.y4m"
            fs.move(part, f"{inner}/{final}")
            return pa.RecordBatch.from_pylist([{"video": key[0], "first": key[1], "frames": n, "path": f"{where}/{final}"}], schema=kind)

        for b in batches:
            for video, first, idx, grey in zip(*(b.column(c).to_pylist() for c in ("video", "_first", "idx", "grey")), strict=True):
                if (video, first) != key:
                    if out is not None:
                        yield done()
                    key, part, n = (video, first), f"{inner}/.{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(part, compression=None)
                    out.write(head)
                if idx != first + n or len(grey) != height * width:
                    raise ValueError(f"frame {idx} of {video} is out of turn or of another size")
                out.write(MARK + b"\n" + grey)
                n += 1
        if out is not None:
            yield done()

    cut = frames.select(F.col("video").cast("string").alias("video"), "idx", "grey").withColumn("_first", F.floor(F.col("idx") / piece) * piece)
    return cut.repartition("video", "_first").sortWithinPartitions("video", "_first", "idx").mapInArrow(run, "video string, first long, frames long, path string")
