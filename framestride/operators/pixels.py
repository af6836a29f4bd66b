"""Frame metrics over exploded pixels (``video? frame, y, x, px``): aggregates, no Python.

Frames are the key of every window and group, so a frame is one unit of work and
frames spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import correlation, let, ratio, uint8, unbiased_kurtosis

# Grey weights, and limits of black, white, stripes, blocks, masks and regions.
GREY = (0.299, 0.587, 0.114)
WHITE, BLACK = 245, 10
EPS = 2.220446049250313e-16
HUE_RED, HUE_GREEN, MIN_SATURATION, MIN_VALUE = ((0, 15), (165, 179)), ((35, 95),), 60, 60


def grey(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma, rounded into 0..255."""
    return uint8(GREY[0] * r + GREY[1] * g + GREY[2] * b)


def explode_pixels(df: DataFrame, array: str, width: int, *keep: str) -> DataFrame:
    """``y, x, px`` of each element of a row-major array."""
    return df.select(*keep, F.posexplode(array).alias("i", "px")).select(*keep, F.call_function("div", F.col("i"), F.lit(width)).cast("int").alias("y"), (F.col("i") % width).alias("x"), "px")


def intensity(px: DataFrame, key: str = "frame") -> DataFrame:
    return px.groupBy(key).agg(F.avg("px").alias("intensity"), F.stddev_pop("px").alias("contrast"))


def extreme_fractions(px: DataFrame, key: str = "frame", white: int = WHITE, black: int = BLACK) -> DataFrame:
    return px.groupBy(key).agg(F.avg((F.col("px") >= white).cast("double")).alias("white"), F.avg((F.col("px") <= black).cast("double")).alias("black"))


def entropy(px: DataFrame, key: str = "frame") -> DataFrame:
    """Bits over the 256 grey values."""
    counts = px.groupBy(key, "px").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    return counts.groupBy(key).agg((F.log2(n.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n).alias("entropy"))


def differences(px: DataFrame, key: str = "frame") -> DataFrame:
    """Adds ``dx, dy``: absolute difference from the left and the upper pixel."""
    return px.withColumns({
        "dx": F.abs(F.col("px") - F.lag("px").over(W.partitionBy(key, "y").orderBy("x"))),
        "dy": F.abs(F.col("px") - F.lag("px").over(W.partitionBy(key, "x").orderBy("y")))})


def stripes(px: DataFrame, key: str = "frame") -> DataFrame:
    """95th percentiles of the rows' mean vertical and the columns' mean horizontal differences."""
    d = differences(px, key)
    rows = d.filter("dy IS NOT NULL").groupBy(key, "y").agg(F.avg("dy").alias("m")).groupBy(key).agg(F.percentile("m", F.lit(0.95)).alias("stripes_h"))
    columns = d.filter("dx IS NOT NULL").groupBy(key, "x").agg(F.avg("dx").alias("m")).groupBy(key).agg(F.percentile("m", F.lit(0.95)).alias("stripes_v"))
    return rows.join(columns, key)


def blockiness(px: DataFrame, block: int = 8, key: str = "frame") -> DataFrame:
    """Mean difference across vertical plus across horizontal block borders; 0 unless there are both."""
    d = differences(px, key)
    at = lambda c: (F.col(c) > 0) & (F.col(c) % block == 0)
    return d.groupBy(key).agg(F.coalesce(F.avg(F.when(at("x"), F.col("dx"))) + F.avg(F.when(at("y"), F.col("dy"))), F.lit(0.0)).alias("blockiness"))


def snr_db(signal: Column, noise: Column) -> Column:
    """Decibels between two powers, both at least the machine's epsilon."""
    return 10 * F.log10(F.greatest(signal, F.lit(EPS)) / F.greatest(noise, F.lit(EPS)))


def reflect(i: Column, n: int) -> Column:
    """Mirrored without repeating the border (101)."""
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def laplacian(grid: Column, height: int, width: int, kernel: int = 1) -> Column:
    """Laplacian of a row-major array as an array: the 4-neighbour kernel (1) or the diagonal one (3)."""
    def px(y: Column, x: Column) -> Column:
        return F.get(grid, (reflect(y, height) * width + reflect(x, width)).cast("int"))

    def at(i: Column) -> Column:
        y, x = F.call_function("div", i, F.lit(width)).cast("int"), i % width
        if kernel == 1:
            return px(y - 1, x) + px(y + 1, x) + px(y, x - 1) + px(y, x + 1) - 4 * px(y, x)
        return 2 * (px(y - 1, x - 1) + px(y - 1, x + 1) + px(y + 1, x - 1) + px(y + 1, x + 1)) - 8 * px(y, x)

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)


def variance(x: Column) -> Column:
    """Population variance of an array."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return let(x, lambda a: let(total(a) / F.size(a), lambda mean: total(F.transform(a, lambda v: (v - mean) * (v - mean))) / F.size(a)))


def residual_metrics(px: DataFrame, key: str = "frame", order: tuple[str, ...] = ("x",), original: str = "original", clean: str = "clean") -> DataFrame:
    """Residual ``original - clean`` of each frame: RMS, mean size, unbiased kurtosis, lag-1 autocorrelation, contrasts.

    One exchange on the frame serves the window and the aggregate.
    """
    r = px.withColumn("r", F.col(original) - F.col(clean))
    r = r.withColumn("before", F.lag("r").over(W.partitionBy(key).orderBy(*order)))
    return r.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("residual_rms"), F.avg(F.abs("r")).alias("residual_mae"), unbiased_kurtosis("r").alias("residual_kurtosis"),
        correlation("before", "r").alias("residual_autocorrelation"), F.stddev_pop(original).alias("contrast_original"), F.stddev_pop(clean).alias("contrast_clean"))


def retention(clean: Column, original: Column) -> Column:
    return clean / F.greatest(original, F.lit(1e-8))


def sample(px: DataFrame, n: int, order: Column, key: str = "frame") -> DataFrame:
    """``n`` pixels of each frame without replacement, those first in a fixed pseudo-random order."""
    return px.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order, "y", "x"))).filter(F.col("_r") <= n).drop("_r")


def in_hue(h: Column, s: Column, v: Column, ranges) -> Column:
    """Whether a colour is in one of the hue ranges (0..179, wrap-around as two) and bright and saturated enough."""
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | h.between(low, high)
    return hit & (s >= MIN_SATURATION) & (v >= MIN_VALUE)


def crop(px: DataFrame, height: int, width: int, margin: float = 0.12) -> DataFrame:
    """Pixels inside a margin on all sides (a share of the side, rounded half to even)."""
    y, x = min(round(height * margin), max(0, height // 2 - 1)), min(round(width * margin), max(0, width // 2 - 1))
    return px.filter(F.col("y").between(y, height - y - 1) & F.col("x").between(x, width - x - 1))


def histogram(px: DataFrame, bins: int, key: str = "frame", top: int = 256) -> DataFrame:
    """``bin, share`` of each frame, shares summing to 1."""
    counts = px.groupBy(key, F.floor(F.col("px") * bins / top).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(key, "bin", ratio("c", F.sum("c").over(W.partitionBy(key))).alias("share"))
