"""Exact order statistics of any number of values, by histograms that are refined around the ranks.

Values of a key are counted in buckets that keep their order; the running count shows
in which bucket a rank lies, and only what lies in such buckets is counted again, in
4096 finer ones between the bucket's least and largest value. A bucket of one value, or
of few, ends the search. So every pass is a count that is summed map-side, no task holds
the values of a key, and several ranks, columns and keys are found at once. The first
buckets are eighths of powers of two, later ones are equal parts, so that five
further passes part any two doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import finite
from framestride.storage import Scratch

#: Buckets of a pass, and values of a bucket that are sorted in its own group.
BINS, FEW = 4096, 16_384
#: First buckets for each power of two.
EIGHTHS = 8


def long_form(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """``_k0, ..., metric, v``: a row for each value; NULL stands for what is missing or not finite."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), finite(c.cast("double")).alias("v")) for n, c in columns.items()])
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(rows).alias("_m")).select(*[f"_k{i}" for i in range(len(keys))], "_m.metric", "_m.v")


def first_bucket(v: Column) -> Column:
    """Numbers that never fall as values rise: powers of two in eighths, by sign."""
    size = F.log2(F.abs(v)) + 1100
    return F.floor(F.when(v > 0, size).when(v < 0, -size).otherwise(0.0) * EIGHTHS)


def same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def quantile_rows(values: DataFrame, n_keys: int, points: dict[str, float], scratch: Scratch) -> DataFrame:
    """``_k0, ..., metric, point, value, n`` of a ``long_form`` that is cheap to read again; interpolated between neighbours, NULL without values.

    All keys of ``values`` are there, also those without a value.
    """
    by = [*[f"_k{i}" for i in range(n_keys)], "metric"]
    theirs = [f"_r{c}" for c in by]
    counted = [F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]
    first = scratch.save(values.groupBy(*by, first_bucket(F.col("v")).alias("bin")).agg(*counted))
    totals = first.groupBy(*by).agg(F.sum("n").alias("total"))
    places = [F.struct(F.lit(name).alias("point"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for name, p in points.items()]
    asked = totals.select(*by, "total", F.explode(F.array(*places)).alias("p")).select(*by, "total", "p.point", F.when(F.col("total") > 0, F.col("p.at")).alias("at"))
    ranks = asked.select(*by, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).filter("rank IS NOT NULL").distinct()

    def placed(counts: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
        """Each wanted rank in the bucket that holds it, with its place there. ``counts``: ``group``, ``n, least, most``."""
        run = counts.filter("n > 0").withColumn("upto", F.sum("n").over(W.partitionBy(*group).orderBy("least")))
        run = run.select(*[F.col(c).alias(f"_r{c}") for c in group], "least", "most", F.col("n").alias("held"), "upto")
        inside = (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("held"))
        hit = wanted.join(run, same(group, [f"_r{c}" for c in group]) & inside)
        return hit.select(*by, "rank", (F.col("place") - F.col("upto") + F.col("held")).alias("place"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("held").alias("n"))

    open_ranks = (F.col("lo") < F.col("hi")) & (F.col("n") > FEW)

    def kept(df: DataFrame) -> tuple[DataFrame, int]:
        """The saved ranks, and how many of them still have to be looked for."""
        seen = Observation()
        out = scratch.save(df.observe(seen, F.count_if(open_ranks).alias("open")))
        return out, seen.get["open"]

    state, left = kept(placed(first, ranks.withColumn("place", F.col("rank")), by))
    group = [*by, "lo", "hi"]
    found = values.select(*[F.col(c).alias(f"_r{c}") for c in by], "v").filter("v IS NOT NULL")

    def within(which: DataFrame) -> DataFrame:
        # ranges are few: as many as keys and ranks
        return found.join(which.select(*group).distinct(), same(by, theirs) & F.col("v").between(F.col("lo"), F.col("hi")))

    while left:
        wide = state.filter(open_ranks)
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        finer = placed(within(wide).groupBy(*group, part.alias("bin")).agg(*counted), wide, group)
        state, left = kept(state.filter(~open_ranks).unionAll(finer))
    # at most FEW values for each range
    lists = within(state.filter("lo < hi")).groupBy(*group).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    lists = lists.select(*[F.col(c).alias(f"_r{c}") for c in group], "vs")
    done = state.join(lists, same(group, [f"_r{c}" for c in group]), "left").select(
        *[F.col(c).alias(f"_r{c}") for c in by], "rank", F.coalesce(F.get("vs", F.col("place").cast("int")), F.col("lo")).alias("value"))
    # both neighbours of each asked place, beside each other
    ends = asked.join(done, same(by, theirs) & ((F.floor("at") == F.col("rank")) | (F.ceil("at") == F.col("rank"))), "left")
    both = ends.groupBy(*by, "point").agg(
        F.first("at").alias("at"), F.first("total").alias("n"), F.min("rank").alias("r_low"), F.max("rank").alias("r_high"), F.min("value").alias("v_low"), F.max("value").alias("v_high"))
    between = F.when(F.col("v_low") == F.col("v_high"), F.col("v_low")).otherwise((F.col("r_high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("r_low")) * F.col("v_high"))
    return both.select(*by, "point", between.alias("value"), "n")


def quantiles(df: DataFrame, keys: list[str], columns: list[str], points: dict[str, float], scratch: Scratch | None = None) -> DataFrame:
    """``keys`` and ``<column>_<point>`` for each point (a share between 0 and 1), exact."""
    scratch = scratch or Scratch(df.sparkSession, "quantiles")
    values = scratch.save(long_form(df, keys, {c: F.col(c) for c in columns}))
    return wide(quantile_rows(values, len(keys), points, scratch), keys, columns, list(points))


def wide(rows: DataFrame, keys: list[str], columns: list[str], points: list[str]) -> DataFrame:
    """Rows of ``quantile_rows`` as one row for each key."""
    cells = [F.max(F.when((F.col("metric") == c) & (F.col("point") == p), F.col("value"))).alias(f"{c}_{p}") for c in columns for p in points]
    return rows.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]).agg(*cells)


def medians_and_deviations(df: DataFrame, keys: list[str], columns: list[str], more: dict[str, float] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``keys``, ``<c>_median``, ``<c>_mad`` (the median distance from it) and ``<c>_<point>`` for ``more`` points."""
    scratch = scratch or Scratch(df.sparkSession, "medians")
    values = scratch.save(long_form(df, keys, {c: F.col(c) for c in columns}))
    points = {"median": 0.5} | (more or {})
    rows = scratch.save(quantile_rows(values, len(keys), points, scratch))
    by = [*[f"_k{i}" for i in range(len(keys))], "metric"]
    middle = rows.filter("point = 'median'").select(*[F.col(c).alias(f"_r{c}") for c in by], F.col("value").alias("m"))
    away = values.join(middle, same(by, [f"_r{c}" for c in by]), "left").select(*by, F.abs(F.col("v") - F.col("m")).alias("v"))
    spread = quantile_rows(away, len(keys), {"mad": 0.5}, scratch)
    return scratch.save(wide(rows.unionAll(spread), keys, columns, [*points, "mad"]))
