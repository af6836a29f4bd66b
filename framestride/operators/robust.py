"""Robust thresholds: exact medians, MADs and percentiles for each key.

They come from ``selection``, which counts values in refined buckets, so a key may have
any number of rows: no task holds its values. The tables of limits have one row for each
key, and rows get theirs by a join with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.operators.selection import medians_and_deviations, same

#: Makes the MAD of normal values their standard deviation.
MAD_SCALE = 1.4826
TINY = 1e-6


def median_mad(df: DataFrame, keys: list[str], columns: list[str], more: dict[str, float] | None = None) -> DataFrame:
    """``<c>_median`` and ``<c>_mad`` for each key over finite values, 0 where there are none; and ``<c>_<point>`` for ``more`` points."""
    out = medians_and_deviations(df.select(*keys, *columns), keys, columns, more)
    return out.withColumns({f"{c}_{s}": F.coalesce(F.col(f"{c}_{s}"), F.lit(0.0)) for c in columns for s in ("median", "mad")})


def pair_thresholds(df: DataFrame, keys: list[str], columns: list[str], percentile: float = 0.975, factor: float = 8.0) -> DataFrame:
    """``<c>_limit`` for each key: the smaller of a percentile and median + factor * scaled MAD."""
    own = median_mad(df, keys, columns, {"high": percentile})
    limits = {c: F.least(F.col(f"{c}_high"), F.col(f"{c}_median") + factor * MAD_SCALE * F.greatest(F.col(f"{c}_mad"), F.lit(TINY))) for c in columns}
    return own.select(*keys, *[x.alias(f"{c}_limit") for c, x in limits.items()])


def floored_thresholds(df: DataFrame, keys: list[str], floors: dict[str, float | None], factor: float = 6.0) -> DataFrame:
    """``<c>_limit`` for each key: median + factor * MAD, at least the floor (if any)."""
    own = median_mad(df, keys, list(floors))
    return own.select(*keys, *[F.greatest(F.col(f"{c}_median") + factor * F.col(f"{c}_mad"), F.lit(f)).alias(f"{c}_limit") for c, f in floors.items()])


def scaled_thresholds(df: DataFrame, keys: list[str], floors: dict[str, float], factor: float = 6.0) -> DataFrame:
    """``<c>_median, <c>_scale, <c>_limit`` for each key: at least the floor, else median + factor * scaled MAD."""
    own = median_mad(df, keys, list(floors))
    scale = {c: F.greatest(MAD_SCALE * F.col(f"{c}_mad"), F.lit(TINY)) for c in floors}
    return own.select(*keys, *[x for c, f in floors.items() for x in (
        F.col(f"{c}_median"), scale[c].alias(f"{c}_scale"), F.greatest(F.lit(f), F.col(f"{c}_median") + factor * scale[c]).alias(f"{c}_limit"))])


def beside(df: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``df`` with its key's limits."""
    plain = limits.withColumnsRenamed({k: f"_limit_{k}" for k in keys})
    return df.join(plain, same(keys, [f"_limit_{k}" for k in keys]), "left").drop(*[f"_limit_{k}" for k in keys])


def with_pair_limits(df: DataFrame, keys: list[str], columns: list[str], percentile: float = 0.975, factor: float = 8.0) -> DataFrame:
    """Rows beside ``pair_thresholds``."""
    return beside(df, pair_thresholds(df, keys, columns, percentile, factor), keys)


def with_floored_limits(df: DataFrame, keys: list[str], floors: dict[str, float | None], factor: float = 6.0) -> DataFrame:
    """Rows beside ``floored_thresholds``."""
    return beside(df, floored_thresholds(df, keys, floors, factor), keys)


def with_scaled_limits(df: DataFrame, keys: list[str], floors: dict[str, float], factor: float = 6.0) -> DataFrame:
    """Rows beside ``scaled_thresholds``."""
    return beside(df, scaled_thresholds(df, keys, floors, factor), keys)
