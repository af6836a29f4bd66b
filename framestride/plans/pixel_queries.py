"""Queries over pixels, histograms, masks and metric tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import let
from framestride.functions.vectors import bhattacharyya as bhattacharyya_distance
from framestride.functions.vectors import mean_abs_difference
from framestride.operators import masks, pixels, summary
from framestride.operators import sequence as seq
from framestride.operators.ordered import own_rows, stretched
from framestride.plans.registry import query
from framestride.plans.scene_queries import BHATT, HIST, histograms
from framestride.plans.sequence_queries import r6
from framestride.sources import tables
from framestride.sources.tables import GRID, LINES, PX, SEQ, grids, sequences

WITH = "WITH "


def px(spark, sf_dir):
    return tables.pixels(spark, sf_dir)


@query(f"{WITH}{SEQ} SELECT video, idx, greatest(0, least(255, round_even(0.299::DOUBLE * (v % 256) + 0.587::DOUBLE * (k * 2) + 0.114::DOUBLE * (idx % 256), 0)))::DOUBLE AS grey FROM seq")
def gray(spark, sf_dir):
    return sequences(spark, sf_dir).select("video", "idx", pixels.grey(F.col("v") % 256, F.col("k") * 2, F.col("idx") % 256).alias("grey"))


@query(f"{WITH}{PX} SELECT frame, round(avg(px), 6) AS intensity, round(stddev_pop(px), 6) AS contrast FROM px GROUP BY frame")
def intensity_contrast(spark, sf_dir):
    return pixels.intensity(px(spark, sf_dir)).select("frame", *r6("intensity", "contrast"))


@query(f"{WITH}{PX} SELECT frame, round(avg((px >= 150)::INT), 6) AS white, round(avg((px <= 100)::INT), 6) AS black FROM px GROUP BY frame")
def extreme_fraction(spark, sf_dir):
    return pixels.extreme_fractions(px(spark, sf_dir), white=150, black=100).select("frame", *r6("white", "black"))


@query(f"{WITH}{PX} SELECT frame, round(entropy(px), 6) AS entropy FROM px GROUP BY frame")
def entropy(spark, sf_dir):
    return pixels.entropy(px(spark, sf_dir)).select("frame", *r6("entropy"))


DIFF = PX + ", dif AS (SELECT *, abs(px - lag(px) OVER (PARTITION BY frame, y ORDER BY x)) AS dx, abs(px - lag(px) OVER (PARTITION BY frame, x ORDER BY y)) AS dy FROM px)"


@query(f"""{WITH}{DIFF}, r AS (SELECT frame, quantile_cont(m, 0.95) AS q FROM (SELECT frame, y, avg(dy) AS m FROM dif WHERE dy IS NOT NULL GROUP BY ALL) GROUP BY frame),
c AS (SELECT frame, quantile_cont(m, 0.95) AS q FROM (SELECT frame, x, avg(dx) AS m FROM dif WHERE dx IS NOT NULL GROUP BY ALL) GROUP BY frame) SELECT frame, round(r.q, 6) AS stripes_h, round(c.q, 6) AS stripes_v FROM r JOIN c USING (frame)""")
def stripes(spark, sf_dir):
    return pixels.stripes(px(spark, sf_dir)).select("frame", *r6("stripes_h", "stripes_v"))


@query(f"{WITH}{DIFF} SELECT frame, round(avg(dx) FILTER (WHERE x > 0 AND x % 4 = 0) + avg(dy) FILTER (WHERE y > 0 AND y % 4 = 0), 6) AS blockiness FROM dif GROUP BY frame")
def blockiness(spark, sf_dir):
    return pixels.blockiness(px(spark, sf_dir), 4).select("frame", *r6("blockiness"))


@query(f"{WITH}{PX} SELECT frame, round(10 * log10(greatest(avg(px * px), 2.220446049250313e-16::DOUBLE) / greatest(var_pop(px), 2.220446049250313e-16::DOUBLE)), 6) AS snr_db FROM px GROUP BY frame")
def snr_db(spark, sf_dir):
    powers = px(spark, sf_dir).groupBy("frame").agg(F.avg(F.col("px") * F.col("px")).alias("signal"), F.var_pop("px").alias("noise"))
    return powers.select("frame", F.round(pixels.snr_db(F.col("signal"), F.col("noise")), 6).alias("snr_db"))


def _mirror(dy: int, dx: int) -> str:
    """SQL for the neighbour of (y, x) with mirrored borders of an 8 x 8 grid."""
    at = lambda c, d: f"(7 - abs(7 - abs({c} + {d})))"
    return f"g.px[({at('p.y', dy)} * 8 + {at('p.x', dx)} + 1)::INT]"


@query(f"""{WITH}{GRID}, lap AS (SELECT p.frame, {_mirror(-1, 0)} + {_mirror(1, 0)} + {_mirror(0, -1)} + {_mirror(0, 1)} - 4 * p.px AS a, 2 * ({_mirror(-1, -1)} + {_mirror(-1, 1)} + {_mirror(1, -1)} + {_mirror(1, 1)}) - 8 * p.px AS b FROM px p JOIN grid g ON p.frame = g.frame)
SELECT frame, round_even(var_pop(a) * 4096, 0) / 4096 AS sharpness_1, round_even(var_pop(b) * 4096, 0) / 4096 AS sharpness_3 FROM lap GROUP BY frame""")
def laplacian_var(spark, sf_dir):
    g = grids(spark, sf_dir)
    own = g.select("frame", pixels.laplacian(F.col("px"), 8, 8, 1).alias("a"), pixels.laplacian(F.col("px"), 8, 8, 3).alias("b"))
    # 64 whole numbers have variances in steps of 1 / 4096
    return own.select("frame", (F.rint(pixels.variance(F.col("a")) * 4096) / 4096).alias("sharpness_1"), (F.rint(pixels.variance(F.col("b")) * 4096) / 4096).alias("sharpness_3"))


RESIDUAL = LINES + """, res AS (SELECT *, original - clean AS r FROM lines), lg AS (SELECT *, lag(r) OVER (PARTITION BY frame ORDER BY x, original, clean) AS p FROM res),
rm AS (SELECT frame, count(*) AS n, sqrt(avg(r * r)) AS residual_rms, avg(abs(r)) AS residual_mae, CASE WHEN count(r) > 3 AND stddev_pop(r) > 0 THEN kurtosis(r) END AS residual_kurtosis,
  CASE WHEN stddev_pop(r) FILTER (WHERE p IS NOT NULL) * stddev_pop(p) > 0 THEN covar_pop(p, r) / (stddev_pop(p) * stddev_pop(r) FILTER (WHERE p IS NOT NULL)) END AS residual_autocorrelation, stddev_pop(original) AS contrast_original, stddev_pop(clean) AS contrast_clean FROM lg GROUP BY frame)"""
RES_COLS = ["residual_rms", "residual_mae", "residual_kurtosis", "residual_autocorrelation", "contrast_original", "contrast_clean"]


def residuals(spark, sf_dir):
    return pixels.residual_metrics(tables.line_pixels(spark, sf_dir), order=("x", "original", "clean"))


@query(f"{WITH}{RESIDUAL} SELECT frame, n, {', '.join(f'round({c} * 1.000000001::DOUBLE, 4) AS {c}' for c in RES_COLS)}, round(contrast_clean / greatest(contrast_original, 1e-8::DOUBLE), 6) AS contrast_retention FROM rm")
def residual_metrics(spark, sf_dir):
    # frames of two or four pixels have halves at the fifth place; a nudge makes all engines round them alike
    return residuals(spark, sf_dir).select("frame", "n", *[F.round(F.col(c) * 1.000000001, 4).alias(c) for c in RES_COLS], F.round(pixels.retention(F.col("contrast_clean"), F.col("contrast_original")), 6).alias("contrast_retention"))


@query(f"{WITH}{PX} SELECT frame, y, x, px FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY ((frame * 7919 + y * 8 + x) * 104729) % 15485863, y, x) AS r FROM px) WHERE r <= 10")
def pixel_sample(spark, sf_dir):
    order = ((F.col("frame") * 7919 + F.col("y") * 8 + F.col("x")) * 104729) % 15485863
    return pixels.sample(px(spark, sf_dir), 10, order).select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "px")


@query(f"{WITH}{PX} SELECT frame, count(*) AS n, round(avg(px), 6) AS mean FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY frame")
def roi_crop(spark, sf_dir):
    return pixels.crop(px(spark, sf_dir), 8, 8).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("px"), 6).alias("mean"))


@query(f"{WITH}{PX} SELECT frame, bin, round(c / sum(c) OVER (PARTITION BY frame), 6) AS share FROM (SELECT frame, floor(px * 16 / 256)::INT AS bin, count(*) AS c FROM px GROUP BY ALL)")
def hist_l1(spark, sf_dir):
    return pixels.histogram(px(spark, sf_dir), 16).select("frame", "bin", *r6("share"))


@query(f"{WITH}{HIST}, l AS (SELECT frame, video, idx, h, lag(h) OVER (PARTITION BY video ORDER BY idx) AS p FROM hst) SELECT video, idx, round({BHATT.format(p='p', q='h')}, 6) AS distance FROM l WHERE p IS NOT NULL")
def bhattacharyya(spark, sf_dir):
    h = own_rows(stretched(histograms(spark, sf_dir), 1).withColumn("p", F.lag("h").over(seq.along(tables.CELL)))).filter("p IS NOT NULL")
    return h.select("video", "idx", F.round(bhattacharyya_distance("p", "h"), 6).alias("distance"))


@query(f"{WITH}{GRID}, l AS (SELECT video, idx, px, lag(px) OVER (PARTITION BY video ORDER BY idx) AS p FROM grid) SELECT video, idx, round(list_sum(list_transform(range(1, 65), lambda i: abs(px[i] - p[i]))) / 64 / 255, 6) AS difference FROM l WHERE p IS NOT NULL")
def mean_abs_diff(spark, sf_dir):
    g = own_rows(stretched(grids(spark, sf_dir), 1).withColumn("p", F.lag("px").over(seq.along(tables.CELL)))).filter("p IS NOT NULL")
    return g.select("video", "idx", F.round(mean_abs_difference("px", "p") / 255, 6).alias("difference"))


# ------------------------------------------------------------------ masks


@query(f"""{WITH}{SEQ}, c AS (SELECT video, idx, floor(k * 1.8::DOUBLE) AS h, v AS s, v + k AS val FROM seq) SELECT video, idx, (h BETWEEN 0 AND 15 OR h BETWEEN 165 AND 179) AND s >= 60 AND val >= 60 AS red, h BETWEEN 35 AND 95 AND s >= 60 AND val >= 60 AS green FROM c""")
def hue_range(spark, sf_dir):
    h, s, v = F.floor(F.col("k") * 1.8), F.col("v"), F.col("v") + F.col("k")
    return sequences(spark, sf_dir).select("video", "idx", pixels.in_hue(h, s, v, pixels.HUE_RED).alias("red"), pixels.in_hue(h, s, v, pixels.HUE_GREEN).alias("green"))


SCREEN = "scr AS (SELECT p_partkey AS pixel, (p_partkey // 192) % 108 AS y, p_partkey % 192 AS x FROM part)"


def screen(spark, sf_dir):
    k = F.col("p_partkey")
    return tables.table(spark, sf_dir, "part").select(k.alias("pixel"), (F.call_function("div", k, F.lit(192)) % 108).alias("y"), (k % 192).alias("x"))


def _inside(r: tuple) -> str:
    x1, x2, y1, y2 = masks.bounds(r, 108, 192)
    return f"x >= {x1} AND x < {x2} AND y >= {y1} AND y < {y2}"


@query(f"{WITH}{SCREEN} SELECT pixel, least({', '.join(f'CASE WHEN {_inside(r)} THEN {r[4]}::DOUBLE END' for r in masks.REGIONS)}) AS threshold FROM scr")
def region_threshold(spark, sf_dir):
    return screen(spark, sf_dir).select("pixel", masks.region_limit(108, 192).alias("threshold"))


@query(f"""{WITH}{SCREEN} SELECT pixel, y < 27 OR y >= 81 OR x < 48 OR x >= 144 OR (y >= 34 AND y < 74 AND x >= 76 AND x < 116) OR (y >= 81 AND x >= 67 AND x < 124) AS inside FROM scr""")
def roi_mask(spark, sf_dir):
    return screen(spark, sf_dir).select("pixel", masks.in_rois(108, 192, centre=20).alias("inside"))


FREQ = PX + ", frq AS (SELECT video, idx // 10 AS block, y, x, avg((px >= 140)::INT) AS frequency, count(*) AS frames FROM px GROUP BY ALL)"


def frequencies(spark, sf_dir):
    g = grids(spark, sf_dir).select("video", seq.block("idx", 10).alias("block"), F.posexplode("px").alias("i", "px"))
    flat = g.select("video", "block", F.call_function("div", F.col("i"), F.lit(8)).alias("y"), (F.col("i") % 8).cast("long").alias("x"), "px")
    return masks.frequency(flat, F.col("px") >= 140, ["video", "block"])


@query(f"{WITH}{FREQ} SELECT video, block, y, x, round(frequency, 6) AS frequency, frames FROM frq")
def pixel_frequency(spark, sf_dir):
    return frequencies(spark, sf_dir).select("video", "block", "y", "x", *r6("frequency"), "frames")


def _inside8(r: tuple) -> str:
    x1, x2, y1, y2 = masks.bounds(r, 8, 8)
    return f"(f.x >= {x1} AND f.x < {x2} AND f.y >= {y1} AND f.y < {y2})"


_CROSS = _inside8(masks.CROSSHAIR)
_LIMIT = f"least({', '.join(f'CASE WHEN {_inside8(r)} THEN {r[4]}::DOUBLE END' for r in masks.REGIONS)})"
_NEAR = "EXISTS (SELECT 1 FROM frq s WHERE s.video = f.video AND s.block = f.block AND s.frequency >= 0.3::DOUBLE AND (s.y - f.y) * (s.y - f.y) + (s.x - f.x) * (s.x - f.x) <= 1)"


@query(f"""{WITH}{FREQ}, u AS (SELECT f.*, {_LIMIT} AS lim, {_CROSS} AS crs, {_NEAR} AS near FROM frq f)
SELECT video, block, y, x, frequency >= 0.3::DOUBLE AS strict, frequency >= 0.65::DOUBLE AND (lim IS NOT NULL OR crs) AS protect, coalesce(frequency >= lim AND near, false) AS allowed,
(coalesce(frequency >= lim AND near, false) OR (crs AND frequency >= 0.22::DOUBLE)) AND y >= 0 AS base FROM u""")
def hud_support(spark, sf_dir):
    return masks.support(frequencies(spark, sf_dir), 8, 8, ["video", "block"], anchor=1).select("video", "block", "y", "x", "strict", "protect", "allowed", "base")


@query(f"""{WITH}{PX}, m AS (SELECT frame, y, x FROM px WHERE px >= 170), o(dy, dx) AS (VALUES {', '.join(str(o) for o in masks.offsets(2))}),
d AS (SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM m, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7) SELECT frame, count(*) AS n, sum(y * 8 + x)::BIGINT AS places FROM d GROUP BY frame""")
def dilate(spark, sf_dir):
    wide = masks.dilate(px(spark, sf_dir).filter("px >= 170"), 2, 8, 8, ["frame"])
    return wide.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 8 + F.col("x")).cast("long").alias("places"))


@query(f"""{WITH}{GRID}, b AS (SELECT p.frame, p.y, p.x, ({' + '.join(f'(g.px[(least(7, greatest(0, p.y + {dy})) * 8 + least(7, greatest(0, p.x + {dx})) + 1)::INT] >= 127)::INT' for dy in (-1, 0, 1) for dx in (-1, 0, 1))}) / 9 AS density FROM px p JOIN grid g ON p.frame = g.frame)
SELECT frame, round(avg(density), 6) AS mean_density, count(*) FILTER (WHERE density >= 0.72::DOUBLE) AS dense FROM b GROUP BY frame""")
def box_density(spark, sf_dir):
    g = grids(spark, sf_dir).select("frame", let(F.transform("px", lambda p: (p >= 127).cast("double")), lambda m: masks.box_mean(m, 8, 8, 3)).alias("d"))
    total = F.aggregate("d", F.lit(0.0), lambda a, v: a + v)
    return g.select("frame", F.round(total / 64, 6).alias("mean_density"), F.size(F.filter("d", lambda v: v >= masks.DENSITY_LIMIT)).cast("long").alias("dense"))


COUNTS = {"candidates": 110, "exact": 150, "supported": 140, "closed": 130, "refined": 135, "cleaned": 138, "final": 125}


@query(f"""{WITH}{PX}, c AS (SELECT frame, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE px >= {t}) AS {n}' for n, t in COUNTS.items())} FROM px GROUP BY frame)
SELECT *, supported - exact AS recovered, candidates - supported AS removed_support, greatest(0, closed - supported) AS added_closing, closed - refined AS removed_density, greatest(0, refined - cleaned) AS removed_area, final - cleaned AS added_dilation,
round(100.0::DOUBLE * candidates / total, 6) AS candidate_pct, round(100.0::DOUBLE * supported / total, 6) AS supported_pct, round(100.0::DOUBLE * final / total, 6) AS final_pct,
CASE WHEN candidates = 0 THEN 0 ELSE round(100.0::DOUBLE * exact / candidates, 6) END AS exact_retention_pct, CASE WHEN candidates = 0 THEN 0 ELSE round(100.0::DOUBLE * supported / candidates, 6) END AS support_retention_pct FROM c""")
def funnel(spark, sf_dir):
    counts = px(spark, sf_dir).groupBy("frame").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("px") >= t).alias(n) for n, t in COUNTS.items()])
    out = masks.funnel(counts)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_pct") else F.col(c) for c in out.columns])


@query(f"{WITH}{SEQ}, b AS (SELECT video, idx // 250 AS block, avg((v >= 50)::INT) AS frequency FROM seq GROUP BY ALL) SELECT s.video, s.idx, s.idx // 250 AS block, round(b.frequency, 6) AS frequency, s.v >= 50 AND b.frequency >= 0.3::DOUBLE AS supported FROM seq s JOIN b ON s.video = b.video AND s.idx // 250 = b.block")
def block_broadcast(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("block", seq.block("idx", 250))
    support = s.groupBy("video", "block").agg(F.avg((F.col("v") >= 50).cast("double")).alias("frequency"))
    # one row for each block: the planner broadcasts it where its size allows
    return s.join(support, ["video", "block"]).select("video", "idx", "block", *r6("frequency"), ((F.col("v") >= 50) & (F.col("frequency") >= 0.3)).alias("supported"))


# ------------------------------------------------------------------ metric tables

_DESCRIBE = "SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation, round(min({c}), 4) AS low, round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS high FROM rm"
STATS = ["mean", "deviation", "low", "q25", "median", "q75", "high"]


@query(f"{WITH}{RESIDUAL} {' UNION ALL '.join(_DESCRIBE.format(c=c) for c in RES_COLS)}")
def describe_metrics(spark, sf_dir):
    return summary.describe(residuals(spark, sf_dir), RES_COLS).select("metric", "n", *[F.round(c, 4).alias(c) for c in STATS])


@query(f"{WITH}{RESIDUAL} {' UNION ALL '.join(f'''SELECT '{c}' AS metric, round(avg({c}), 4) AS mean FROM rm''' for c in RES_COLS)}")
def stage_means(spark, sf_dir):
    return summary.stage_means(residuals(spark, sf_dir), RES_COLS).select("metric", F.round("mean", 4).alias("mean"))


@query(f"""{WITH}{RESIDUAL} SELECT 'frames_original' AS stage, count(*) AS frames, round(avg(contrast_original), 4) AS contrast, NULL::DOUBLE AS rms, NULL::DOUBLE AS autocorrelation FROM rm
UNION ALL SELECT 'frames_n2n_original', count(*), round(avg(contrast_clean), 4), round(avg(residual_rms), 4), round(avg(abs(residual_autocorrelation)), 4) FROM rm""")
def before_after(spark, sf_dir):
    out = summary.before_after(residuals(spark, sf_dir), "frames_original", "frames_n2n_original", {
        "contrast": ("contrast_original", "contrast_clean"), "rms": (None, "residual_rms"), "autocorrelation": (None, "residual_autocorrelation_abs")})
    return out.select("stage", "frames", *[F.round(c, 4).alias(c) for c in ("contrast", "rms", "autocorrelation")])


@query("SELECT CASE WHEN value < 0 THEN -1 WHEN value > 500 THEN 40 ELSE least(floor((value - 0) / ((500.0::DOUBLE - 0) / 40)), 39)::BIGINT END AS bin, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1")
def hist_bins(spark, sf_dir):
    return summary.histogram(tables.table(spark, sf_dir, "events"), "value", 0.0, 500.0, 40)


@query("""WITH s AS (SELECT avg(d) AS m, stddev_pop(d) AS s, quantile_cont(abs(d), 0.995) AS lim FROM (SELECT value - 50 AS d FROM events)), g AS (SELECT *, unnest(range(300)) AS i FROM s), x AS (SELECT *, -lim + i * (2 * lim / 299) AS x FROM g)
SELECT i, round(x, 4) AS x, round(exp(-0.5::DOUBLE * ((x - m) / s) * ((x - m) / s)) / (s * sqrt(2 * pi())), 8) AS density FROM x""")
def normal_overlay(spark, sf_dir):
    d = tables.table(spark, sf_dir, "events").select((F.col("value") - 50).alias("d"))
    return summary.normal_overlay(d, "d").select("i", F.round("x", 4).alias("x"), F.round("density", 8).alias("density"))
