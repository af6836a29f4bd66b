"""Order over many tasks: numbers of rows, stretches with a halo, running values that are carried on.

A sequence may be longer than a task should hold, so nothing here has a window over
a whole key. Rows are sorted into ranges; a range is counted, and what was counted
before it is added. Neighbours are found within stretches of rows that also have some
rows from beyond both ends. Running sums are sums within a stretch and the sum of
the stretches before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.storage import Scratch

#: Bits of a row's place within its task, as ``monotonically_increasing_id`` has them.
PLACE_BITS = 33
#: Rows of a stretch.
STRETCH = 1 << 16


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, keys: list[str] | None = None, index: str = "idx", total: str | None = None) -> DataFrame:
    """``df`` with its place from 0 in an order, within the keys if any; ``total``: the number of rows of the key as well.

    One range exchange; the rows are written once, sorted, and the counts of each
    range and key (as many as ranges and keys together) are added up.
    """
    keys = keys or []
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + order
    # a stated number of ranges is kept as it is, so a row's task is its range
    rows = scratch.save(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_fs_place", F.monotonically_increasing_id()))
    names = [f"_fs_k{i}" for i in range(len(keys))]
    spans = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.shiftright("_fs_place", PLACE_BITS).alias("_fs_range")).agg(
        F.min("_fs_place").alias("_fs_first"), F.count(F.lit(1)).alias("_fs_n"))
    before = W.partitionBy(*names).orderBy("_fs_range").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumns({"_fs_before": F.coalesce(F.sum("_fs_n").over(before), F.lit(0)), "_fs_all": F.sum("_fs_n").over(W.partitionBy(*names))})
    out = rows.join(scratch.save(spans), (F.shiftright("_fs_place", PLACE_BITS) == F.col("_fs_range")) & _same(keys, names))
    more = [F.col("_fs_all").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_fs_before") + F.col("_fs_place") - F.col("_fs_first")).alias(index), *more)


def stretched(df: DataFrame, halo: int, size: int | None = None, index: str = "idx") -> DataFrame:
    """Every row once for each stretch of ``size`` rows that needs it: ``_stretch`` and ``_mine`` (false for rows of the halo).

    Windows by key and ``_stretch`` see the ``halo`` rows before and after the rows that are the stretch's own.
    """
    size = size or STRETCH

    def number(at: Column) -> Column:
        return F.call_function("div", at, F.lit(size).cast("long"))

    at = F.col(index).cast("long")
    low, high = number(F.greatest(at - halo, F.lit(0).cast("long"))), number(at + halo)
    inner = (low == high) & F.lit(halo < size)
    out = df.withColumn("_stretch", F.explode(F.when(inner, F.array(low)).otherwise(F.sequence(low, high))))
    return out.withColumn("_mine", number(at) == F.col("_stretch"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_mine").drop("_mine", "_stretch")


def running_sum(df: DataFrame, value: str, name: str, key: str, index: str = "idx", size: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` from the key's first row up to this one."""
    cell = F.call_function("div", F.col(index).cast("long"), F.lit(size or STRETCH).cast("long"))
    own = df.withColumn("_cell", cell)
    within = own.withColumn("_run", F.sum(value).over(W.partitionBy(key, "_cell").orderBy(index)))
    sums = own.groupBy(F.col(key).alias("_key"), F.col("_cell").alias("_c")).agg(F.sum(value).alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = within.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_c")))
    return out.select(*df.columns, (F.coalesce("_run", F.lit(0)) + F.col("_before")).alias(name))
