"""Batch inference with a pluggable model: blocks with halo, resume, and checks of what comes back.

A model is any function from a list of images to a list of images. Training of
neural nets, video codecs and image-quality models are outside this library.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.functions.columns import finite
from framestride.operators.relational import missing, require
from framestride.operators.sequence import block, with_halo

Model = Callable[[list[np.ndarray]], list[np.ndarray]]


@dataclass(frozen=True)
class TrainingConfig:
    """What a trainer outside this library is told; written beside its model."""

    patch: int = 128
    batch: int = 8
    depth: int = 4
    channels: int = 48
    residual: bool = True
    epochs: int = 50
    steps: int = 2000
    precision: str = "32"
    clip: float = 1.0


def history(epochs: DataFrame) -> DataFrame:
    """``epoch, train_loss, val_loss, minutes`` as they are; fails at a loss that isn't finite."""
    ok = finite("train_loss").isNotNull() & finite("val_loss").isNotNull()
    return require(epochs.select("epoch", "train_loss", "val_loss", "minutes"), ok, "a loss isn't finite")


def checked(model: Model, images: list[np.ndarray]) -> list[np.ndarray]:
    """The model's images; fails on another number of them, another shape, or values that aren't finite."""
    out = model(images)
    if len(out) != len(images):
        raise ValueError(f"the model returned {len(out)} images for {len(images)}")
    for a, b in zip(images, out, strict=True):
        if a.shape != b.shape:
            raise ValueError(f"the model returned shape {b.shape} for {a.shape}")
        if not np.isfinite(b).all():
            raise ValueError("the model returned values that aren't finite")
    return out


def tiles(height: int, width: int, size: int = 128, overlap: int = 48) -> list[tuple[int, int]]:
    """Upper left corners of tiles that cover an image and overlap; the last ones end at the border."""
    def starts(n: int) -> list[int]:
        if n <= size:
            return [0]
        return sorted({min(i, n - size) for i in range(0, n - overlap, size - overlap)})

    return [(y, x) for y in starts(height) for x in starts(width)]


def run_tiled(model: Model, image: np.ndarray, size: int = 128, overlap: int = 48) -> np.ndarray:
    """The model tile by tile, overlaps averaged."""
    out, n = np.zeros(image.shape, dtype=np.float64), np.zeros(image.shape, dtype=np.float64)
    for y, x in tiles(*image.shape[:2], size, overlap):
        part = image[y : y + size, x : x + size]
        out[y : y + size, x : x + size] += checked(model, [part])[0]
        n[y : y + size, x : x + size] += 1
    return out / n


def infer_blocks(frames: DataFrame, model: Model, size: int = 80, halo: int = 10, key: str = "video", index: str = "idx", values: str = "values") -> DataFrame:
    """``key, index, values`` of every frame from blocks of ``size`` that also see ``halo`` frames on both sides.

    ``values`` are flat arrays. A block is a bounded group of ``size + 2 halo`` frames; what
    the model makes of the halo is dropped.
    """
    schema = f"{key} string, {index} long, {values} array<double>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        out = checked(model, [np.asarray(v, dtype=np.float64) for v in pdf[values]])
        pdf = pdf.assign(**{values: [x.tolist() for x in out]})
        return pdf.loc[pdf["is_center"], [key, index, values]]

    wide = with_halo(frames, size, halo, key, index).select(key, index, values, "block", "is_center")
    return wide.groupBy(key, "block").applyInPandas(one, schema)


def resume(frames: DataFrame, done: DataFrame, model: Model, size: int = 16, key: str = "video", index: str = "idx", values: str = "values") -> DataFrame:
    """Run the model on frames that ``done`` doesn't have yet, in blocks without halo, and return both."""
    left = missing(frames, done, [key, index])
    new = infer_blocks(left.withColumn("_b", block(index, size)), model, size, 0, key, index, values)
    return done.select(key, index, values).unionByName(new)


def completeness(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``expected, found, complete`` for each key."""
    a = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    b = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    return a.join(b, keys, "left").select(*keys, "expected", F.coalesce("found", F.lit(0).cast("long")).alias("found")).withColumn("complete", F.col("expected") == F.col("found"))
