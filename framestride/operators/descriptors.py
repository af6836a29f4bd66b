"""From images to the tables that the sequence operators read: descriptors of frames, scores of pairs.

Every image is decoded and shrunk once; what leaves the kernel are histograms,
figures and a small grey frame. Pairs come from ``lag`` on those columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framestride.functions.vectors import bhattacharyya
from framestride.operators import kernels
from framestride.operators.overlay import image_array
from framestride.operators.sequence import along

# Sides, margins and bins of the descriptors, and the height of the small frames of pairs.
ANALYSIS_SIDE, MARGIN = 640, 0.12
BINS_HUE, BINS_SATURATION, BINS_GREY = 32, 32, 64
PAIR_HEIGHT = 180
WHITE, BLACK = 245, 10

DESCRIPTOR = ("histogram_hs array<double>, histogram_grey array<double>, intensity double, contrast double, saturation double, white double, black double, entropy double, "
              "stripes_h double, stripes_v double, blocks double, edge_density double, small_height int, small_width int, small binary")


def prepared(rgb: np.ndarray, side: int = ANALYSIS_SIDE, margin: float = MARGIN) -> np.ndarray:
    """Shrunk to a longest side, without its margins."""
    h, w = rgb.shape[:2]
    scale = min(1.0, side / max(h, w))
    if scale < 1:
        rgb = np.rint(kernels.area_resize(rgb, round(h * scale), round(w * scale))).astype(np.uint8)
        h, w = rgb.shape[:2]
    y, x = min(round(h * margin), max(0, h // 2 - 1)), min(round(w * margin), max(0, w // 2 - 1))
    return rgb[y : h - y, x : w - x]


def describe(rgb: np.ndarray) -> dict:
    """The descriptor of one frame."""
    roi = prepared(rgb)
    hsv, g = kernels.hsv(roi), kernels.grey(roi)
    f = g.astype(np.float64)
    hs = np.histogram2d(hsv[..., 0].ravel(), hsv[..., 1].ravel(), bins=(BINS_HUE, BINS_SATURATION), range=((0, 180), (0, 256)))[0].ravel()
    grey = np.bincount((g.ravel().astype(np.int64) * BINS_GREY) // 256, minlength=BINS_GREY)
    p = np.bincount(g.ravel(), minlength=256) / g.size
    p = p[p > 0]
    down, right = np.abs(np.diff(f, axis=0)), np.abs(np.diff(f, axis=1))
    across, along_ = np.abs(f[:, 8::8] - f[:, 7:-1:8]), np.abs(f[8::8] - f[7:-1:8])
    whole = kernels.grey(rgb)
    small = kernels.area_resize(whole, PAIR_HEIGHT, max(1, round(whole.shape[1] * PAIR_HEIGHT / whole.shape[0])))
    return {
        "histogram_hs": (hs / hs.sum()).tolist(), "histogram_grey": (grey / grey.sum()).tolist(), "intensity": float(f.mean()), "contrast": float(f.std()), "saturation": float(hsv[..., 1].mean()),
        "white": float((g >= WHITE).mean()), "black": float((g <= BLACK).mean()), "entropy": float(-(p * np.log2(p)).sum()),
        "stripes_h": float(np.percentile(down.mean(1), 95)) if down.size else 0.0, "stripes_v": float(np.percentile(right.mean(0), 95)) if right.size else 0.0,
        "blocks": float(across.mean() + along_.mean()) if across.size and along_.size else 0.0, "edge_density": float(kernels.canny(g).mean()),
        "small_height": small.shape[0], "small_width": small.shape[1], "small": small.astype("<f4").tobytes()}


def frame_descriptors(frames: DataFrame) -> DataFrame:
    """The descriptor of each row of ``video, idx, frame, image``; an unreadable frame is an error of the job."""
    schema = f"video string, idx long, frame string, {DESCRIPTOR}"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"video": v, "idx": i, "frame": n, **describe(image_array(x))} for v, i, n, x in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return frames.select("video", "idx", "frame", "image").mapInArrow(run, schema)


def with_pair_changes(d: DataFrame) -> DataFrame:
    """Adds ``hs, di, sat``: distance of colour histograms, differences of intensity and saturation from the frame before."""
    w = along()
    before = d.withColumn("_h", F.lag("histogram_hs").over(w))
    return before.withColumns({
        "hs": F.when(F.col("_h").isNotNull(), bhattacharyya("_h", "histogram_hs")), "di": F.abs(F.col("intensity") - F.lag("intensity").over(w)) / 255, "sat": F.abs(F.col("saturation") - F.lag("saturation").over(w)) / 255}).drop("_h")


def pair_scores(d: DataFrame) -> DataFrame:
    """``video, idx, frame, frame_target, difference, motion, response`` of each frame and the next: mean grey difference and shift by phase correlation."""
    w = along()
    schema = "video string, idx long, frame string, frame_target string, difference double, motion double, response double"
    kind = to_arrow_schema(StructType.fromDDL(schema))
    pairs = d.select("video", "idx", "frame", F.lead("frame").over(w).alias("frame_target"), "small_height", "small_width", "small", F.lead("small").over(w).alias("target")).filter("target IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                x, y = (np.frombuffer(r[c], dtype="<f4") for c in ("small", "target"))
                if len(x) != len(y):
                    raise ValueError(f"frames {r['frame']} and {r['frame_target']} have different shapes")
                x, y = (v.reshape(r["small_height"], r["small_width"]).astype(np.float64) for v in (x, y))
                dx, dy, response = kernels.phase_shift(x, y)
                rows.append({n: r[n] for n in ("video", "idx", "frame", "frame_target")} | {"difference": float(np.abs(x - y).mean()), "motion": float(np.hypot(dx, dy)), "response": response})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return pairs.mapInArrow(run, schema)
