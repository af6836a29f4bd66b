"""Summaries: descriptive statistics, stage means, histograms and curves for plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.functions.columns import finite
from framestride.operators.selection import long_form, quantile_rows
from framestride.storage import Scratch


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, value`` of every finite value."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), finite(F.col(c).cast("double")).alias("value")) for c in columns])).alias("m")).select("m.metric", "m.value")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    scratch = Scratch(df.sparkSession, "describe")
    values = scratch.save(long_form(df, [], {c: F.col(c) for c in columns}))
    v = F.col("v")
    moments = values.groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high"))
    rows = quantile_rows(values, 0, {"q25": 0.25, "median": 0.5, "q75": 0.75}, scratch)
    quarters = rows.groupBy(F.col("metric").alias("_metric")).agg(*[F.max(F.when(F.col("point") == p, F.col("value"))).alias(p) for p in ("q25", "median", "q75")])
    return moments.join(quarters, F.col("metric") == F.col("_metric")).select("metric", "n", "mean", "deviation", "low", "q25", "median", "q75", "high")


def stage_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, mean`` of each column."""
    return unpivoted(df, columns).groupBy("metric").agg(F.avg("value").alias("mean"))


def before_after(df: DataFrame, before: str, after: str, columns: dict[str, tuple[str | None, str]]) -> DataFrame:
    """Two labelled rows of means: for each name the column before (None: not there) and after.

    One pass over the frames; a name whose after column is the residual's
    autocorrelation takes the mean of its absolute value if it ends in ``_abs``.
    """
    def mean(c: str):
        return F.avg(F.abs(c[: -len("_abs")])) if c.endswith("_abs") else F.avg(c)

    one = df.agg(F.count(F.lit(1)).alias("frames"), *[mean(b).alias(f"b_{n}") for n, (b, _) in columns.items() if b], *[mean(a).alias(f"a_{n}") for n, (_, a) in columns.items()])
    row = lambda label, side: F.struct(F.lit(label).alias("stage"), "frames", *[(F.col(f"{side}_{n}") if side == "a" or b else F.lit(None).cast("double")).alias(n) for n, (b, _) in columns.items()])
    return one.select(F.explode(F.array(row(before, "b"), row(after, "a"))).alias("r")).select("r.*")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of equal bins; the last one holds its upper bound too. Values below are bin -1, values above are bin ``bins``; only missing ones are left out."""
    v = F.col(value)
    inside = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    at = F.when(v < low, -1).when(v > high, bins).otherwise(inside).cast("long")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def normal_overlay(df: DataFrame, value: str, points: int = 300, percentile: float = 0.995) -> DataFrame:
    """``i, x, density``: the normal curve with the values' mean and deviation, over a symmetric range."""
    scratch = Scratch(df.sparkSession, "overlay")
    sizes = scratch.save(long_form(df, [], {value: F.abs(F.col(value))}))
    limit = quantile_rows(sizes, 0, {"limit": percentile}, scratch).select(F.greatest("value", F.lit(2.220446049250313e-16)).alias("lim"))
    # both sides are one row
    s = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).join(limit, F.lit(True))
    grid = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = -F.col("lim") + F.col("i") * (2 * F.col("lim") / (points - 1))
    z = (F.col("x") - F.col("m")) / F.col("s")
    return grid.withColumn("x", x).select(F.col("i").cast("long").alias("i"), "x", F.when(F.col("s") > 0, F.exp(-0.5 * z * z) / (F.col("s") * math.sqrt(2 * math.pi))).otherwise(F.lit(0.0)).alias("density"))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """``metric, n_nan, n_infinite, n_null`` of each column."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.metric", "m.v")
    return rows.groupBy("metric").agg(
        F.count_if(F.coalesce(F.isnan("v"), F.lit(False))).alias("n_nan"), F.count_if(F.coalesce(F.abs("v") == float("inf"), F.lit(False))).alias("n_infinite"), F.count_if(F.col("v").isNull()).alias("n_null"))
