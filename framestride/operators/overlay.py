"""Overlay masks from images, end to end: colour masks, temporal support by block, masks of frames, funnel.

Two passes over the images. The first makes a colour mask of each frame and adds
them up by block: a partial sum for each task and block, so that what is shuffled
are a few arrays for each block. The second joins each frame with its block's
support and refines its mask. A block's support is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framestride.operators import kernels, masks
from framestride.operators.pixels import HUE_GREEN, HUE_RED
from framestride.operators.sequence import block

# Sizes of the shapes of the last steps, and the least area of a part.
CLOSING, PROTECT_RADIUS, FINAL_DILATION, MIN_AREA = 1, 2, 1, 2
#: Stricter colours and their dark rim, for the variant with one mask for all frames.
STRICT_GREEN, STRICT_SATURATION, STRICT_VALUE, DARK, PRESENCE = ((40, 90),), 150, 170, 75, 0.90

FUNNEL = ["total", "green", "red", "candidates", "exact", "supported", "closed", "protected", "refined", "cleaned", "final"]


def colour_masks(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Green and red overlay pixels."""
    h = kernels.hsv(rgb)
    return kernels.hue_mask(h, HUE_GREEN), kernels.hue_mask(h, HUE_RED)


def region_limits(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest limit of the regions that cover each pixel (infinite outside) and the crosshair."""
    limit, cross = np.full((height, width), np.inf), np.zeros((height, width), dtype=bool)
    for r in masks.REGIONS:
        x1, x2, y1, y2 = masks.bounds(r, height, width)
        limit[y1:y2, x1:x2] = np.minimum(limit[y1:y2, x1:x2], r[4])
    x1, x2, y1, y2 = masks.bounds(masks.CROSSHAIR, height, width)
    cross[y1:y2, x1:x2] = True
    return limit, cross


def block_support(frequency: np.ndarray) -> dict[str, np.ndarray]:
    """``base``, ``support`` (base, wider) and ``protect`` of a block from its pixels' frequencies."""
    limit, cross = region_limits(*frequency.shape)
    near = kernels.dilate(frequency >= masks.STRICT, kernels.ellipse(masks.ANCHOR_RADIUS))
    base = ((frequency >= limit) & near) | ((frequency >= masks.CROSSHAIR_LIMIT) & cross)
    wide = kernels.dilate(base, kernels.ellipse(masks.SUPPORT_RADIUS))
    top = round(frequency.shape[0] * masks.TOP_MARGIN)
    base[:top], wide[:top] = False, False
    return {"base": base, "support": wide, "protect": (frequency >= masks.PROTECT) & (np.isfinite(limit) | cross)}


def frame_mask(rgb: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, dict]:
    """The refined mask of a frame and the counts of its steps."""
    s = block_support(frequency)
    green, red = colour_masks(rgb)
    own = green | red
    exact, supported = own & s["base"], own & s["support"]
    closed = kernels.close(supported, kernels.ellipse(CLOSING))
    protect = kernels.dilate(s["protect"], kernels.ellipse(PROTECT_RADIUS))
    dense = kernels.box_mean(closed, masks.DENSITY_WINDOW) >= masks.DENSITY_LIMIT
    refined = closed & ~(dense & ~protect)
    cleaned, areas = kernels.drop_small(refined, MIN_AREA)
    final = kernels.dilate(cleaned, kernels.ellipse(FINAL_DILATION))
    steps = [np.ones_like(own), green, red, own, exact, supported, closed, closed & protect, refined, cleaned, final]
    counts = {n: int(x.sum()) for n, x in zip(FUNNEL, steps, strict=True)}
    mean = lambda m: float(frequency[m].mean()) if m.any() else 0.0
    return final, counts | {
        "parts": len(areas), "area_min": int(areas.min()) if len(areas) else 0, "area_median": float(np.median(areas)) if len(areas) else 0.0, "area_max": int(areas.max()) if len(areas) else 0,
        "frequency_candidates": mean(own), "frequency_final": mean(final), "frequency_final_min": float(frequency[final].min()) if final.any() else 0.0}


def image_array(i: dict) -> np.ndarray:
    return kernels.to_rgb(np.frombuffer(i["data"], dtype=np.uint8).reshape(i["height"], i["width"], i["nChannels"]))


def block_frequencies(frames: DataFrame, size: int = masks.BLOCK_FRAMES, mask=lambda rgb: np.logical_or(*colour_masks(rgb))) -> DataFrame:
    """``video, block, frames, height, width, frequency`` (float32 bytes) from ``video, idx, image``.

    Frames of another size than the block's first one are an error.
    """
    kind = pa.schema([("video", pa.string()), ("block", pa.int64()), ("frames", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("hits", pa.binary())])
    schema = "video string, block long, frames long, height int, width int, hits binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for b in batches:
            for video, n, image in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                hit = mask(image_array(image))
                own = sums.setdefault((video, n, *hit.shape), [0, np.zeros(hit.shape, dtype="<i4")])
                own[0] += 1
                own[1] += hit
                if len(sums) > 8:  # only a few blocks are open at once
                    yield out(sums)
                    sums.clear()
        if sums:
            yield out(sums)

    def out(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"video": v, "block": n, "frames": c, "height": h, "width": w, "hits": s.tobytes()} for (v, n, h, w), (c, s) in sums.items()], schema=kind)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf[["height", "width"]].drop_duplicates().shape[0] > 1:
            raise ValueError(f"frames of several sizes in block {pdf['block'][0]} of {pdf['video'][0]}")
        hits = sum(np.frombuffer(x, dtype="<i4").astype(np.int64) for x in pdf["hits"])
        n = int(pdf["frames"].sum())
        return pdf.iloc[:1][["video", "block", "height", "width"]].assign(frames=n, frequency=[(hits / n).astype("<f4").tobytes()])[["video", "block", "frames", "height", "width", "frequency"]]

    parts = frames.select("video", block("idx", size).alias("block"), "image").mapInArrow(partial, schema)
    return parts.groupBy("video", "block").applyInPandas(total, "video string, block long, frames long, height int, width int, frequency binary")


DIAGNOSTICS = "video string, idx long, block long, " + ", ".join(f"{n} long" for n in FUNNEL) + ", parts long, area_min long, area_median double, area_max long, frequency_candidates double, frequency_final double, frequency_final_min double, mask binary, error string"


def overlay_masks(frames: DataFrame, size: int = masks.BLOCK_FRAMES) -> DataFrame:
    """A refined mask (bytes of 0 and 255) and its counts for each frame of ``video, idx, image``; failures are the ``error`` of their row."""
    kind = to_arrow_schema(StructType.fromDDL(DIAGNOSTICS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                row = {"video": r["video"], "idx": r["idx"], "block": r["block"], "error": None}
                try:
                    frequency = np.frombuffer(r["frequency"], dtype="<f4").reshape(r["height"], r["width"])
                    final, counts = frame_mask(image_array(r["image"]), frequency)
                    row |= counts | {"mask": (final.astype(np.uint8) * 255).tobytes()}
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kind.names} for r in rows], schema=kind)

    own = frames.select("video", "idx", block("idx", size).alias("block"), "image")
    return own.join(block_frequencies(frames, size).drop("frames"), ["video", "block"]).mapInArrow(run, DIAGNOSTICS)


def steady_mask(frames: DataFrame, share: float = PRESENCE) -> DataFrame:
    """One mask for each video: strict green beside a dark rim, inside the regions, in ``share`` of the frames.

    ``frames``: ``video, idx, image``, as many as shall count.
    """

    def strict(rgb: np.ndarray) -> np.ndarray:
        h, w = rgb.shape[:2]
        green = kernels.hue_mask(kernels.hsv(rgb), STRICT_GREEN, STRICT_SATURATION, STRICT_VALUE)
        rim = kernels.dilate(kernels.grey(rgb) < DARK, kernels.ellipse(2))
        return green & rim & rois(h, w)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, n = int(pdf["height"][0]), int(pdf["width"][0]), int(pdf["frames"][0])
        hits = np.rint(np.frombuffer(pdf["frequency"][0], dtype="<f4").reshape(h, w).astype(np.float64) * n)
        mask = kernels.close(hits >= int(n * share), np.ones((3, 3), dtype=bool)) if int(n * share) else np.ones((h, w), dtype=bool)
        final, areas = kernels.drop_small(kernels.dilate(mask, kernels.ellipse(1)), MIN_AREA)
        return pdf[["video", "frames", "height", "width"]].assign(parts=len(areas), mask=[(final.astype(np.uint8) * 255).tobytes()])

    whole = block_frequencies(frames, 1 << 40, strict)
    return whole.groupBy("video").applyInPandas(finish, "video string, frames long, height int, width int, parts long, mask binary")


def rois(height: int, width: int, centre: int = 140) -> np.ndarray:
    """The border, the centre square and the lower middle, as an array."""
    y, x = np.mgrid[:height, :width]
    dy, dx = int(height * 0.25), int(width * 0.25)
    edge = (y < dy) | (y >= height - dy) | (x < dx) | (x >= width - dx)
    middle = (abs(2 * y + 1 - 2 * (height // 2)) < 2 * centre) & (abs(2 * x + 1 - 2 * (width // 2)) < 2 * centre)
    return edge | middle | ((y >= int(height * 0.75)) & (x >= int(width * 0.35)) & (x < int(width * 0.65)))


def funnel(diagnostics: DataFrame) -> DataFrame:
    """Differences and shares of the steps beside the counts of ``overlay_masks``."""
    return masks.funnel(diagnostics.filter(F.col("error").isNull()))
