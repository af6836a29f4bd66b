"""Test tables seen as frame sequences: the adapters that queries run on.

Events of a type are a video whose frames are in the order of time; embeddings
are 8 x 8 grey frames; order lines are pixels of frames before and after a
clean-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.functions.columns import round_scaled, uint8
from framestride.operators.ordered import numbered
from framestride.operators.sequence import along
from framestride.storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Windows over stretches of a video.
CELL = ["video", "_stretch"]


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video, idx, frame, v, k`` and ``_len``, the number of the video's frames; numbered over many tasks and saved."""
    e = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "video", "value": "v"})
    own = e.select("video", "ts", "event_id", "v", F.regexp_extract("props", r"(\d+)", 1).try_cast("double").alias("k"))
    out = numbered(own, [F.col("ts"), F.col("event_id")], Scratch(spark, "sequences"), ["video"], total="_len").drop("ts", "event_id")
    return out.withColumn("frame", F.concat(F.lit("frame_"), F.lpad(F.col("idx").cast("string"), 7, "0"), F.lit(".png")))


def with_changes(seq: DataFrame, key: str | list[str] = "video") -> DataFrame:
    """Adds ``hs, di, sat``: changes from the frame before."""
    w = along(key)
    dv, dk = F.abs(F.col("v") - F.lag("v").over(w)), F.abs(F.col("k") - F.lag("k").over(w))
    return seq.withColumns({"hs": dv / 300, "di": dk / 400, "sat": dk / 100})


def with_looks(seq: DataFrame) -> DataFrame:
    """Adds what a frame and its geometry look like, from its two measures."""
    v, k = F.col("v"), F.col("k")
    return seq.withColumns({
        "white": F.least(F.lit(1.0), v / 285), "black": F.when(k < 1, 0.9).otherwise(0.1), "contrast": 7 + k, "entropy": 2.95 + k / 20, "stripes_h": v / 10, "stripes_v": k / 10, "blocks": v * k / 1000,
        "matches": k.cast("long"), "inliers": (k % 10) / 10, "scale": F.when(k % 7 != 0, round_scaled(1 + (v - 30) / 2000, 3))})


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, video, idx, px``: arrays of 64 grey values, frames of a label in the order of their ids."""
    e = table(spark, sf_dir, "embeddings")
    px = F.transform("embedding", lambda x: uint8((x.cast("double") + 0.5) * 255))
    own = e.select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("video"), px.alias("px"))
    return numbered(own, [F.col("frame")], Scratch(spark, "grids"), ["video"], total="_len").select("frame", "video", "idx", "px", "_len")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, y, x, px`` of the grids."""
    e = table(spark, sf_dir, "embeddings")
    flat = e.select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "e"))
    return flat.select("frame", F.call_function("div", F.col("i"), F.lit(8)).cast("int").alias("y"), (F.col("i") % 8).alias("x"), uint8((F.col("e").cast("double") + 0.5) * 255).alias("px"))


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame, x, original, clean`` of order lines."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("x"), F.col("l_extendedprice").alias("original"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("clean"))


# The same adapters for DuckDB.
SEQ = r"""seq AS (
  SELECT event_type AS video, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS v, try_cast(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k FROM events
), seqf AS (SELECT *, 'frame_' || lpad(idx::VARCHAR, 7, '0') || '.png' AS frame FROM seq)"""
CHG = SEQ + """, chg AS (
  SELECT *, abs(v - lag(v) OVER w) / 300 AS hs, abs(k - lag(k) OVER w) / 400 AS di, abs(k - lag(k) OVER w) / 100 AS sat FROM seqf WINDOW w AS (PARTITION BY video ORDER BY idx)
)"""
LOOKS = CHG + """, looks AS (
  SELECT *, least(1.0::DOUBLE, v / 285) AS white, CASE WHEN k < 1 THEN 0.9::DOUBLE ELSE 0.1 END AS black, 7 + k AS contrast, 2.95::DOUBLE + k / 20 AS entropy, v / 10 AS stripes_h, k / 10 AS stripes_v, v * k / 1000 AS blocks,
         k::BIGINT AS matches, (k % 10) / 10 AS inliers, CASE WHEN k % 7 <> 0 THEN round(1 + (v - 30) / 2000, 3) END AS scale FROM chg
)"""
PX = """px AS (
  SELECT frame, video, idx, i // 8 AS y, i % 8 AS x, greatest(0, least(255, round_even((emb[i + 1]::DOUBLE + 0.5) * 255, 0)))::DOUBLE AS px
  FROM (SELECT vec_id AS frame, label::BIGINT AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding AS emb, unnest(range(64)) AS i FROM embeddings)
)"""
GRID = PX + ", grid AS (SELECT frame, any_value(video) AS video, any_value(idx) AS idx, list(px ORDER BY y, x) AS px FROM px GROUP BY frame)"
LINES = "lines AS (SELECT l_orderkey AS frame, l_linenumber AS x, l_extendedprice AS original, l_extendedprice * (1 - l_discount) AS clean FROM lineitem)"
