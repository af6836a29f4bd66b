"""Overlay masks: temporal frequency by pixel, regions, support, density, and the funnel of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.functions.columns import ratio

# Frequency limits, radii, and the regions of the screen with their own limits.
STRICT, PROTECT, CROSSHAIR_LIMIT = 0.30, 0.65, 0.22
ANCHOR_RADIUS, SUPPORT_RADIUS, TOP_MARGIN = 10, 2, 0.02
DENSITY_WINDOW, DENSITY_LIMIT = 41, 0.72
BLOCK_FRAMES = 250
#: x from, x to, y from, y to (shares of the screen), limit.
REGIONS = [
    (0.00, 0.30, 0.02, 0.15, 0.10), (0.37, 0.63, 0.02, 0.14, 0.08), (0.70, 1.00, 0.02, 0.15, 0.10),
    (0.00, 0.14, 0.15, 0.34, 0.18), (0.86, 1.00, 0.15, 0.34, 0.18), (0.00, 0.14, 0.64, 0.98, 0.18), (0.86, 1.00, 0.64, 0.98, 0.18),
    (0.00, 0.30, 0.80, 0.99, 0.10), (0.36, 0.64, 0.80, 0.99, 0.10), (0.70, 1.00, 0.80, 0.99, 0.10),
]
CROSSHAIR = (0.39, 0.61, 0.36, 0.66)


def frequency(px: DataFrame, hit: Column, keys: list[str]) -> DataFrame:
    """Share of a block's frames in which each pixel is a hit: one sum for each pixel, map-side first."""
    return px.groupBy(*keys, "y", "x").agg(F.avg(hit.cast("double")).alias("frequency"), F.count(F.lit(1)).alias("frames"))


def bounds(region: tuple, height: int, width: int) -> tuple[int, int, int, int]:
    """Pixel bounds of a region: x from, x past, y from, y past (rounded half to even)."""
    return round(width * region[0]), round(width * region[1]), round(height * region[2]), round(height * region[3])


def inside(region: tuple, height: int, width: int) -> Column:
    x1, x2, y1, y2 = bounds(region, height, width)
    return (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)


def region_limit(height: int, width: int, regions=REGIONS) -> Column:
    """The smallest limit of the regions that cover a pixel; NULL outside of all.

    Regions are a few constants, so this is a column and no join.
    """
    return F.least(*[F.when(inside(r, height, width), F.lit(r[4])) for r in regions], F.lit(None).cast("double"))


def in_rois(height: int, width: int, border: float = 0.25, centre: int = 140, low: tuple = (0.75, 0.35, 0.65)) -> Column:
    """Whether a pixel is in the border, the centre square (``centre`` to each side) or the lower middle of the screen."""
    y, x = F.col("y"), F.col("x")
    dy, dx = int(height * border), int(width * border)
    edge = (y < dy) | (y >= height - dy) | (x < dx) | (x >= width - dx)
    middle = (y >= height // 2 - centre) & (y < height // 2 + centre) & (x >= width // 2 - centre) & (x < width // 2 + centre)
    return edge | middle | ((y >= int(height * low[0])) & (x >= int(width * low[1])) & (x < int(width * low[2])))


def offsets(radius: int) -> list[tuple[int, int]]:
    """Places of an ellipse with this radius: rows of the widths that a disc of it has, rounded."""
    out = []
    for dy in range(-radius, radius + 1):
        half = round((radius * radius - dy * dy) ** 0.5)
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def dilate(mask: DataFrame, radius: int, height: int, width: int, keys: list[str]) -> DataFrame:
    """``y, x`` of every pixel within an ellipse around a pixel of ``mask``, once each."""
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets(radius)])
    moved = mask.select(*keys, "y", "x", F.explode(around).alias("o")).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


def support(freq: DataFrame, height: int, width: int, keys: list[str], anchor: int = ANCHOR_RADIUS) -> DataFrame:
    """Adds ``strict, protect, allowed, base``: what frequencies and regions say of each pixel.

    ``base`` is allowed by its region's limit and near a strict pixel, or in the
    crosshair by its own limit, and not in the top margin.
    """
    limit, cross = region_limit(height, width), inside((*CROSSHAIR, 0.0), height, width)
    own = freq.withColumns({"strict": F.col("frequency") >= STRICT, "_limit": limit})
    near = dilate(own.filter("strict"), anchor, height, width, keys).withColumn("_near", F.lit(True))
    own = own.join(near, [*keys, "y", "x"], "left")
    own = own.withColumn("protect", (F.col("frequency") >= PROTECT) & (F.col("_limit").isNotNull() | cross))
    own = own.withColumn("allowed", F.coalesce((F.col("frequency") >= F.col("_limit")) & F.col("_near"), F.lit(False)))
    base = (F.col("allowed") | (cross & (F.col("frequency") >= CROSSHAIR_LIMIT))) & (F.col("y") >= round(height * TOP_MARGIN))
    return own.withColumn("base", base).drop("_limit", "_near")


def funnel(counts: DataFrame) -> DataFrame:
    """Differences and shares from a frame's counts; shares of nothing are 0."""
    share = lambda a, b: F.coalesce(ratio(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    return counts.withColumns({
        "recovered": F.col("supported") - F.col("exact"), "removed_support": F.col("candidates") - F.col("supported"), "added_closing": F.greatest(F.lit(0).cast("long"), F.col("closed") - F.col("supported")),
        "removed_density": F.col("closed") - F.col("refined"), "removed_area": F.greatest(F.lit(0).cast("long"), F.col("refined") - F.col("cleaned")), "added_dilation": F.col("final") - F.col("cleaned"),
        "candidate_pct": share("candidates", "total"), "supported_pct": share("supported", "total"), "final_pct": share("final", "total"),
        "exact_retention_pct": share("exact", "candidates"), "support_retention_pct": share("supported", "candidates")})


def box_mean(grid: Column, height: int, width: int, size: int) -> Column:
    """Mean of a small square window with repeated borders, for a row-major array; use the kernel for large windows."""
    r = size // 2

    def clamp(i: Column, n: int) -> Column:
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), i))

    def at(i: Column) -> Column:
        y, x = F.call_function("div", i, F.lit(width)).cast("int"), i % width
        near = [F.get(grid, (clamp(y + dy, height) * width + clamp(x + dx, width)).cast("int")) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
        return sum(near[1:], near[0]) / (size * size)

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)
