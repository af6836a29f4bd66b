"""Queries on motion between frames: PNG files that Spark writes from the tables and reads back, and the small grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.functions.columns import uint8
from framestride.operators import motion
from framestride.operators.ordered import numbered
from framestride.plans.media_queries import bytes_of
from framestride.plans.pixel_queries import WITH
from framestride.plans.registry import query
from framestride.sources import images
from framestride.sources.tables import PX, grids, table
from framestride.storage import Scratch

#: Vectors of a picture (16 tiles of 8 x 8 in a row), frames that look at it, and how far the view moves from one to the next.
TILES, ACROSS, VIEWS, MARGIN, RIGHT, DOWN = 256, 16, 5, 32, 3, 2


def views(spark, sf_dir: str) -> DataFrame:
    """``name, height, width, rgb``: views of pictures made of the vectors, each moved on from the one before.

    A picture has 256 vectors by their ids, the last one up to 511.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), bytes_of(F.transform("embedding", lambda x: uint8((x.cast("double") + 0.5) * 255))).alias("tile"))
    own = numbered(e, [F.col("frame")], Scratch(spark, "pictures"), total="_len")
    last = F.greatest(F.call_function("div", F.col("_len"), F.lit(TILES)) - 1, F.lit(0))
    own = own.select(F.least(F.call_function("div", F.col("idx"), F.lit(TILES)), last).alias("picture"), F.struct("idx", "tile").alias("t"))
    whole = own.groupBy("picture").agg(F.array_sort(F.collect_list("t")).alias("tiles"))
    kind = pa.schema([("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for picture, tiles in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = -(-len(tiles) // ACROSS)
                g = np.zeros((rows * ACROSS, 8, 8), np.uint8)
                g[: len(tiles)] = [np.frombuffer(t["tile"], np.uint8).reshape(8, 8) for t in tiles]
                g = g.reshape(rows, ACROSS, 8, 8).swapaxes(1, 2).reshape(rows * 8, ACROSS * 8)
                h, w = (n - MARGIN for n in g.shape)
                seen = [np.repeat(g[DOWN * t : DOWN * t + h, RIGHT * t : RIGHT * t + w, None], 3, axis=2) for t in range(VIEWS)]
                yield pa.RecordBatch.from_pylist([{"name": f"{picture}_{t}.png", "height": h, "width": w, "rgb": x.tobytes()} for t, x in enumerate(seen)], schema=kind)

    return whole.mapInArrow(run, "name string, height int, width int, rgb binary")


def read_back(spark, frames: DataFrame, label: str) -> DataFrame:
    """``video, idx, image`` of ``frames`` called ``<video>_<idx>.png``, written and read as files."""
    where = Scratch(spark, label).path("frames")
    images.write_frames(frames, where).write.format("noop").mode("overwrite").save()
    return images.read_frames(spark, where).select(F.substring_index("frame", "_", 1).alias("video"), F.regexp_extract("frame", r"_(\d+)\.", 1).cast("long").alias("idx"), "image")


@query(f"SELECT p::VARCHAR AS video, i AS idx, true AS found, 1.0::DOUBLE AS scale, 0::BIGINT AS angle, {-RIGHT}::BIGINT AS dx, {-DOWN}::BIGINT AS dy FROM (SELECT unnest(range(greatest(count(*) // {TILES}, 1))) AS p FROM embeddings HAVING count(*) > 0), range({VIEWS - 1}) t(i)")
def frame_geometry(spark, sf_dir):
    """What corners of frames say about a view that moves by a known step."""
    moved = motion.gated(motion.geometry_changes(motion.frame_corners(read_back(spark, views(spark, sf_dir), "views"))))
    whole = lambda c: F.rint(c).cast("long").alias(c)
    return moved.select("video", "idx", ((F.col("matches") >= motion.LEAST) & (F.col("inliers") > 0.5)).alias("found"), F.round("scale", 2).alias("scale"), whole("angle"), whole("dx"), whole("dy"))


# eighth turns, so that what cancels is zero
COS = "list_extract([1, sqrt(0.5), 0, -sqrt(0.5), -1, -sqrt(0.5), 0, sqrt(0.5)]::DOUBLE[], ((%s) %% 8 + 1)::INT)"


@query(f"""{WITH}{PX}, uv AS (SELECT u.range AS u, v.range AS v FROM range(8) u, range(8) v),
f AS (SELECT video, idx, u, v, sum(px * {COS % '(u * y + v * x)'}) AS re, -sum(px * {COS % '(u * y + v * x + 6)'}) AS im FROM px, uv GROUP BY ALL),
r AS (SELECT a.video, a.idx, a.u, a.v, a.re * b.re + a.im * b.im AS re, a.re * b.im - a.im * b.re AS im FROM f a JOIN f b ON a.video = b.video AND b.idx = a.idx + 1 AND a.u = b.u AND a.v = b.v),
n AS (SELECT video, idx, u, v, re / greatest(sqrt(re * re + im * im), 1e-12::DOUBLE) AS re, im / greatest(sqrt(re * re + im * im), 1e-12::DOUBLE) AS im FROM r),
c AS (SELECT video, idx, (uv.u + 4) % 8 AS y, (uv.v + 4) % 8 AS x, sum(n.re * {COS % '(n.u * uv.u + n.v * uv.v)'} - n.im * {COS % '(n.u * uv.u + n.v * uv.v + 6)'}) / 64 AS c FROM n, uv GROUP BY ALL),
top AS (SELECT video, idx, y AS ty, x AS tx FROM c QUALIFY row_number() OVER (PARTITION BY video, idx ORDER BY round(c, 9) DESC, y, x) = 1),
s AS (SELECT video, idx, sum(greatest(c, 0)) AS w, sum(greatest(c, 0) * x) AS wx, sum(greatest(c, 0) * y) AS wy FROM c JOIN top USING (video, idx) WHERE abs(y - ty) <= 2 AND abs(x - tx) <= 2 GROUP BY ALL),
d AS (SELECT p.video, p.idx, avg(abs(p.px - q.px)) AS difference FROM px p JOIN px q ON q.video = p.video AND q.idx = p.idx + 1 AND q.y = p.y AND q.x = p.x GROUP BY ALL)
SELECT video::VARCHAR AS video, idx, round(difference, 6) AS difference, round(sqrt((wx / w - 4) ** 2 + (wy / w - 4) ** 2), 6) AS movement, round(w, 6) AS response, NULL::VARCHAR AS error FROM s JOIN d USING (video, idx)""")
def pair_motion(spark, sf_dir):
    """Mean difference, movement and response of consecutive frames."""
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), bytes_of(F.col("px")).alias("data"))
    moved = motion.phase_shifts(motion.small_frames(grids(spark, sf_dir).select("video", "idx", image.alias("image"))))
    return moved.select("video", "idx", F.round("difference", 6).alias("difference"), F.round("movement", 6).alias("movement"), F.round("response", 6).alias("response"), "error")
