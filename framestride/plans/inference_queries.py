"""Queries on batch inference: blocks that see frames beyond their ends, and a run that goes on where another stopped."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framestride.operators import inference
from framestride.plans.pixel_queries import WITH
from framestride.plans.registry import query
from framestride.sources.tables import PX, grids

#: Frames of a block, and those it also sees on either side.
SIZE, HALO = 80, 10


def smooth(frames: list[np.ndarray]) -> list[np.ndarray]:
    """A model that needs neighbours: the mean of up to two frames before, the frame and up to two after."""
    return [np.mean(frames[max(0, i - 2) : i + 3], axis=0) for i in range(len(frames))]


def invert(frames: list[np.ndarray]) -> list[np.ndarray]:
    """A model that needs none."""
    return [255 - x for x in frames]


def valued(spark, sf_dir):
    return grids(spark, sf_dir).select(F.col("video").cast("string").alias("video"), "idx", F.col("px").alias("values"))


def total(df):
    """``values`` as their sum and their sum by place."""
    placed = F.transform("values", lambda v, i: v * (i + 1))
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 3)
    return df.select("video", "idx", F.size("values").cast("long").alias("n"), add(F.col("values")).alias("total"), add(placed).alias("weighted"))


SUMS = "count(*) AS n, round(sum(v), 3) AS total, round(sum(v * (y * 8 + x + 1)), 3) AS weighted"


@query(f"""{WITH}{PX}, s AS (SELECT video, idx, y, x, avg(px) OVER (PARTITION BY video, y, x ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM px)
SELECT video::VARCHAR AS video, idx, {SUMS} FROM s GROUP BY ALL""")
def block_inference(spark, sf_dir):
    """A temporal model by blocks with a halo: as over whole videos."""
    return total(inference.infer_blocks(valued(spark, sf_dir), smooth, SIZE, HALO))


@query(f"{WITH}{PX}, s AS (SELECT video, idx, y, x, 255 - px AS v FROM px) SELECT video::VARCHAR AS video, idx, {SUMS} FROM s GROUP BY ALL")
def resumed_inference(spark, sf_dir):
    """A run that finds a third of the frames done and makes the rest."""
    frames = valued(spark, sf_dir)
    done = inference.infer_blocks(frames.filter("idx % 3 = 1"), invert, SIZE, 0)
    return total(inference.resume(frames, done, invert))
