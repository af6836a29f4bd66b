"""Joins, set operations and upserts with the checks that data sets need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails where a key stands twice on either side.

    Each side counts its keys in the join's own partitioning, so the check adds
    no exchange.
    """
    w = W.partitionBy(*keys)

    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(w)
        ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"key twice on the {side} side: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
        return df.withColumn("_once", ok).filter("_once").drop("_once")

    return checked(left, "left").join(checked(right, "right"), keys, "left")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left side without a partner: what is pending, or lost."""
    return left.join(right.select(*keys), keys, "left_anti")


def in_both(df: DataFrame, first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in two other tables."""
    return df.join(first.select(*keys), keys, "left_semi").join(second.select(*keys), keys, "left_semi")


def mismatches(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Places at which two sequences of names differ or one has ended: ``key, left_name, right_name``."""
    a, b = left.select(F.col(key), F.col(name).alias("left_name")), right.select(F.col(key), F.col(name).alias("right_name"))
    return a.join(b, key, "full_outer").filter(~F.col("left_name").eqNullSafe(F.col("right_name")))


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, first: str, last: str, width: int = 64) -> DataFrame:
    """Points with the interval of their key that holds them.

    Intervals are cut to the stretches of ``width`` places they touch, which makes the
    join an equality on key and stretch.
    """
    stretch = lambda c: F.call_function("div", F.col(c), F.lit(width))
    cut = intervals.withColumn("_s", F.explode(F.sequence(stretch(first), stretch(last))))
    return points.withColumn("_s", stretch(at)).join(cut, [key, "_s"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("_s")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split: ``group, n_splits``."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def upsert_rows(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Old rows without the keys of the new ones, and those; ``place`` is the key's rank in ``order``, unknown ones last."""
    both = missing(old, new, [key]).unionByName(new, allowMissingColumns=True)
    return ranked(both, key, order)


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``place``: where the key stands in a list of labels; unknown and missing ones follow by name."""
    known = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(key))
    rank = F.when(known > 0, known).otherwise(F.lit(len(order) + 1))
    return df.withColumn("place", F.row_number().over(W.orderBy(rank, F.col(key).asc_nulls_last())).cast("long"))


def upsert_column(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old wide table with the new one's columns; a column of the same name is replaced, keys of both stay."""
    own = [c for c in old.columns if c == key or c not in new.columns]
    return old.select(*own).join(new, key, "full_outer")


def assert_counts(df: DataFrame, expected: Column, found: Column) -> DataFrame:
    """``df`` with ``complete``: whether counts agree."""
    return df.withColumn("complete", expected.eqNullSafe(found))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing at the first row for which the condition isn't true."""
    ok = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.withColumn("_ok", ok).filter("_ok").drop("_ok")
