"""Ordered sequences: neighbours, islands, spacing, buckets, splits, sampling.

Windows are by key and ordered by the index. A key may be a list: with ``ordered.stretched``
rows it is the sequence and the stretch, so that a sequence of any length is spread over
many tasks. What has to know all rows before (running counts, numbers) is carried from
stretch to stretch.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import natural_key
from framestride.operators.ordered import numbered, running_sum
from framestride.operators.spacing import spaced
from framestride.storage import Scratch

Key = str | list[str]


def along(key: Key = "video", index: str = "idx") -> WindowSpec:
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(index)


def natural_index(df: DataFrame, name: str, key: str, tie: str) -> DataFrame:
    """Adds ``idx``: the place in natural order of names within the key."""
    return numbered(df, [natural_key(name), F.col(tie)], Scratch(df.sparkSession, "names"), [key])


def with_next(df: DataFrame, columns: list[str], by: int = 1, suffix: str = "_next", key: Key = "video", index: str = "idx") -> DataFrame:
    """Adds each column's value ``by`` places later."""
    return df.withColumns({f"{c}{suffix}": F.lead(c, by).over(along(key, index)) for c in columns})


def change(c: str | Column, key: Key = "video", index: str = "idx") -> Column:
    """Absolute difference from the place before; NULL at the first."""
    c = F.col(c) if isinstance(c, str) else c
    return F.abs(c - F.lag(c).over(along(key, index)))


def pairs(df: DataFrame, columns: list[str], key: Key = "video", index: str = "idx") -> DataFrame:
    """Each place beside the next one: ``<c>_target``; the last place has no pair."""
    w = along(key, index)
    return df.withColumns({f"{c}_target": F.lead(c).over(w) for c in columns} | {"_has": F.lead(F.lit(1)).over(w)}).filter("_has = 1").drop("_has")


def islands(df: DataFrame, broken: str, key: str = "video", index: str = "idx") -> DataFrame:
    """``scene, first_idx, last_idx, n`` of maximal runs of rows that aren't ``broken``; scenes count from 1."""
    runs = running_sum(df.select(key, index, F.col(broken).cast("int").alias("_bad")), "_bad", "_run", key, index).filter("_bad = 0")
    out = runs.groupBy(key, "_run").agg(F.min(index).alias("first_idx"), F.max(index).alias("last_idx"), F.count(F.lit(1)).alias("n"))
    out = numbered(out, [F.col("first_idx")], Scratch(df.sparkSession, "islands"), [key], index="_scene")
    return out.select(key, (F.col("_scene") + 1).alias("scene"), "first_idx", "last_idx", "n")


def spaced_cuts(df: DataFrame, candidate: str, total: str, edge: int = 8, least: int = 8, key: str = "video", index: str = "idx") -> DataFrame:
    """``key, cut``: candidates not nearer than ``edge`` to either end, spaced greedily; ``total`` is the length of the sequence."""
    inside = df.filter(F.col(candidate) & (F.col(index) >= edge) & (F.col(total) - F.col(index) >= edge))
    return spaced(inside, [key], least, index=index)


def block(index: str | Column, size: int) -> Column:
    """Number of the block of ``size`` places."""
    index = F.col(index) if isinstance(index, str) else index
    return F.call_function("div", index, F.lit(size))


def with_halo(df: DataFrame, size: int, halo: int, key: str = "video", index: str = "idx") -> DataFrame:
    """Every row once for each block that needs it: ``block`` and ``is_center``.

    A block covers ``size`` places and reads ``halo`` more on both sides; rows
    outside the sequence don't exist, so borders are clipped by themselves.
    """
    last = df.groupBy(F.col(key).alias("_key")).agg(F.max(index).alias("_last"))
    df = df.join(last, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    low = F.greatest(F.lit(0), block(F.greatest(F.lit(0), F.col(index) - halo), size))
    high = F.least(block(F.col(index) + halo, size), block("_last", size))
    out = df.withColumn("block", F.explode(F.sequence(low.cast("long"), high.cast("long")))).drop("_last")
    return out.withColumn("is_center", block(index, size) == F.col("block"))


def round_robin(index: str, parts: int) -> Column:
    return F.pmod(F.col(index), F.lit(parts))


def systematic_split(df: DataFrame, valid: str, share: float = 0.05, key: str = "video", index: str = "idx") -> DataFrame:
    """Adds ``split``: of the valid rows every n-th is ``valid``, the others ``train``; the rest is ``excluida``."""
    every = max(2, round(1 / share))
    nth = running_sum(df.withColumn("_valid", F.col(valid).cast("int")), "_valid", "_nth", key, index)
    return nth.withColumn("split", F.when(~F.col(valid), "excluida").when(F.col("_nth") % every == 0, "valid").otherwise("train")).drop("_valid", "_nth")


def time_buckets(df: DataFrame, buckets: int = 5, key: str = "video", index: str = "idx") -> DataFrame:
    """Adds ``bucket``: equal-count stretches whose bounds are cut to whole numbers (not ``ntile``)."""
    ranked = numbered(df, [F.col(index)], Scratch(df.sparkSession, "buckets"), [key], index="_rank", total="_n")
    # the last k with floor(k n / buckets) <= rank
    return ranked.withColumn("bucket", F.call_function("div", (F.col("_rank") + 1) * buckets - 1, F.col("_n")).cast("long")).drop("_rank", "_n")


def with_minmax(df: DataFrame, columns: list[str], key: list[str], prefix: str = "n_") -> DataFrame:
    """Adds each column between 0 and 1 within the key; missing counts as 0, a constant gives 0."""
    value = {c: F.coalesce(c, F.lit(0.0)) for c in columns}
    bounds = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(*[f(v).alias(f"_{s}_{c}") for c, v in value.items() for s, f in (("low", F.min), ("high", F.max))])
    out = df.join(bounds, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]))
    scaled = {f"{prefix}{c}": F.when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), (v - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}"))).otherwise(F.lit(0.0)) for c, v in value.items()}
    return out.withColumns(scaled).select(*df.columns, *scaled)


def best_per(df: DataFrame, score: str, key: list[str], index: str = "idx") -> DataFrame:
    """The row with the highest score of each key, the first of equal ones: a maximum for each task, then one for each key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(index)).alias("_i"))).alias("_b"))
    return best.select(*key, "_b.*").select(*df.columns)


def resample(videos: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Source indices for a requested rate: ``position, source_idx`` for each row of ``videos``.

    Columns read: ``fps, total, begin, until, fps_out``. Each output time takes the
    nearest source frame (half to even), kept inside the interval; equal
    neighbours are dropped. An equal rate takes every frame of the interval.
    """
    first = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("begin") * F.col("fps")).cast("long"))
    past = F.least(F.col("total"), F.ceil(F.col("until") * F.col("fps")).cast("long"))
    same = F.abs(F.col("fps_out") - F.col("fps")) <= tolerance
    n = F.ceil((F.col("until") - F.col("begin")) * F.col("fps_out") - 1e-9).cast("long")
    nearest = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda p: F.least(F.greatest(F.rint((F.col("begin") + p / F.col("fps_out")) * F.col("fps")).cast("long"), first), past - 1))
    every = F.when(past > first, F.sequence(first, past - 1)).otherwise(F.array().cast("array<bigint>"))
    # times ascend, so equal ones are neighbours
    picked = F.when(same, every).when((n < 1) | (past <= first), F.array().cast("array<bigint>")).otherwise(F.array_distinct(nearest))
    return videos.select("*", F.posexplode(picked).alias("position", "source_idx")).withColumn("position", F.col("position").cast("long"))


def even_places(n: Column, most: int) -> Column:
    """Up to ``most`` evenly spread places of ``0 .. n - 1``, first and last among them."""
    k = F.least(F.lit(most).cast("long"), n.cast("long"))
    step = F.when(k > 1, (n - 1) / (k - 1)).otherwise(F.lit(0.0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.rint(i * step).cast("long")))


def spacing_of(names: int) -> int:
    """Digits in the file names of so many frames."""
    return max(4, int(math.log10(max(1, names))) + 1)
