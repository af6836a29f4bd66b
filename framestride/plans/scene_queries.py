"""Queries over scenes, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.functions.vectors import bhattacharyya, cosine_distance, l1_unit
from framestride.operators import relational, robust, scenes
from framestride.operators import sequence as seq
from framestride.operators.ordered import own_rows, stretched
from framestride.plans.registry import query
from framestride.plans.sequence_queries import CLASSIFIED, CUT_FLOORS, CUT_LIMITS, changes, r6, states
from framestride.sources.tables import CELL, CHG, GRID, SEQ, grids, sequences, table

WITH, RECURSIVE = "WITH ", "WITH RECURSIVE "

ISLANDS = CLASSIFIED + """, run AS (SELECT video, idx, sum(a7::INT) OVER (PARTITION BY video ORDER BY idx) AS run, a7 FROM s7),
isl AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY min(idx)) AS scene, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM run WHERE NOT a7 GROUP BY video, run)"""


@query(f"{WITH}{ISLANDS} SELECT video, scene, first_idx, last_idx, n FROM isl")
def scene_islands(spark, sf_dir):
    return seq.islands(states(spark, sf_dir, 7), "anomaly")


@query(f"{WITH}{ISLANDS} SELECT s.video, s.idx, scene FROM seq s JOIN isl i ON s.video = i.video AND s.idx BETWEEN i.first_idx AND i.last_idx")
def interval_join_scene(spark, sf_dir):
    found = seq.islands(states(spark, sf_dir, 7), "anomaly")
    return relational.in_intervals(sequences(spark, sf_dir).select("video", "idx"), found, "video", "idx", "first_idx", "last_idx").select("video", "idx", "scene")


@query(f"""{WITH}{CHG}, {CUT_LIMITS}, z AS (SELECT video, idx, hs, di, hs_limit, di_limit, coalesce((hs - hs_median) / hs_scale, 0) AS z_hs, coalesce((di - di_median) / di_scale, 0) AS z_di FROM chg JOIN lim USING (video))
SELECT video, idx, round(z_hs, 6) AS z_hs, round(z_di, 6) AS z_di, round(0.65::DOUBLE * z_hs + 0.35::DOUBLE * z_di, 6) AS score,
coalesce(hs >= hs_limit, false) OR coalesce(di >= di_limit, false) AS over_limit, idx > 0 AND (coalesce(hs >= hs_limit, false) OR coalesce(di >= di_limit, false)) AND 0.65::DOUBLE * z_hs + 0.35::DOUBLE * z_di >= 3.5::DOUBLE AS candidate FROM z""")
def cut_candidates(spark, sf_dir):
    ch = changes(spark, sf_dir)
    out = scenes.cut_candidates(robust.with_scaled_limits(ch, ["video"], CUT_FLOORS))
    over = F.coalesce(F.col("hs") >= F.col("hs_limit"), F.lit(False)) | F.coalesce(F.col("di") >= F.col("di_limit"), F.lit(False))
    return out.select("video", "idx", *r6("z_hs", "z_di", "score"), over.alias("over_limit"), "candidate")


CUTS = SEQ + """, num AS (SELECT *, count(*) OVER (PARTITION BY video) AS n FROM seq), cnd AS (SELECT video, idx FROM num WHERE v >= 110 AND idx >= 8 AND n - idx >= 8),
g AS (SELECT video, min(idx) AS cut FROM cnd GROUP BY video UNION ALL SELECT g.video, min(c.idx) AS cut FROM g JOIN cnd c ON c.video = g.video AND c.idx >= g.cut + 8 GROUP BY g.video)"""


def cuts(rows: DataFrame) -> DataFrame:
    return seq.spaced_cuts(rows.withColumn("_c", F.col("v") >= 110), "_c", "_len")


@query(f"{RECURSIVE}{CUTS} SELECT video, cut FROM g")
def greedy_spacing(spark, sf_dir):
    return cuts(sequences(spark, sf_dir))


BOUNDS = CUTS + """, lim AS (SELECT video, 0::BIGINT AS first_idx, max(n) AS n FROM num GROUP BY video UNION ALL SELECT g.video, cut, m.n FROM g JOIN (SELECT video, max(n) AS n FROM num GROUP BY video) m USING (video)),
b0 AS (SELECT video, n, first_idx, lead(first_idx, 1, n) OVER (PARTITION BY video ORDER BY first_idx) AS past, row_number() OVER (PARTITION BY video ORDER BY first_idx) AS scene FROM lim),
b1 AS (SELECT *, past - 1 AS last_idx, past - first_idx AS frames, CASE WHEN first_idx > 0 THEN first_idx + 2 ELSE first_idx END AS valid_first, CASE WHEN past < n THEN past - 3 ELSE past - 1 END AS valid_last FROM b0),
bnd AS (SELECT *, greatest(0, valid_last - valid_first + 1) AS valid_frames, greatest(0, greatest(0, valid_last - valid_first + 1) - 1) AS pairs FROM b1)"""


def bounds(spark, sf_dir) -> DataFrame:
    rows = sequences(spark, sf_dir)
    return scenes.scene_bounds(rows.groupBy("video").agg(F.max("_len").alias("n")), cuts(rows))


@query(f"{RECURSIVE}{BOUNDS} SELECT video, scene, first_idx, last_idx, frames, valid_first, valid_last, valid_frames, pairs FROM bnd")
def scene_bounds(spark, sf_dir):
    return bounds(spark, sf_dir)


@query(f"""{RECURSIVE}{BOUNDS}, p AS (SELECT video, scene, valid_first, valid_frames AS m, least(12, valid_frames) AS k, unnest(range(least(12, valid_frames))) AS i FROM bnd WHERE valid_frames > 0)
SELECT DISTINCT video, scene, valid_first + round_even(CASE WHEN k > 1 THEN i * ((m - 1) / (k - 1)) ELSE 0 END, 0)::BIGINT AS idx FROM p""")
def scene_sample(spark, sf_dir):
    own = bounds(spark, sf_dir).filter("valid_frames > 0")
    return own.select("video", "scene", "valid_first", F.explode(seq.even_places(F.col("valid_frames"), 12)).alias("p")).select("video", "scene", (F.col("valid_first") + F.col("p")).alias("idx"))


@query(f"""{RECURSIVE}{BOUNDS} SELECT video, scene % 7 AS visual_group, count(*) AS n_scenes, sum(pairs)::BIGINT AS pairs, sum(valid_frames)::BIGINT AS valid_frames,
string_agg('escena_' || lpad(scene::VARCHAR, 4, '0'), ';' ORDER BY scene) AS scenes, greatest(sum(pairs), sum(valid_frames))::BIGINT AS weight FROM bnd GROUP BY ALL""")
def group_weights(spark, sf_dir):
    named = bounds(spark, sf_dir).withColumns({"name": F.format_string("escena_%04d", F.col("scene")), "visual_group": F.col("scene") % 7, "_g": F.struct("video", (F.col("scene") % 7).alias("visual_group"))})
    return scenes.group_weights(named, "_g", "name", "pairs", "valid_frames").select("_g.video", "_g.visual_group", "n_scenes", "pairs", "valid_frames", "scenes", "weight")


SPLIT_SQL = "CASE WHEN scene % 7 < 5 THEN 'train' WHEN scene % 7 = 5 THEN 'valid' ELSE 'test' END"


@query(f"""{RECURSIVE}{BOUNDS}, t AS (SELECT *, {SPLIT_SQL} AS split FROM bnd) SELECT split, count(DISTINCT scene % 7) AS n_groups, count(*) AS n_scenes, sum(valid_frames)::BIGINT AS frames,
round(sum(valid_frames) / sum(sum(valid_frames)) OVER (), 6) AS share FROM t GROUP BY split""")
def split_summary(spark, sf_dir):
    g = F.col("scene") % 7
    t = bounds(spark, sf_dir).withColumns({"g": g, "split": F.when(g < 5, "train").when(g == 5, "valid").otherwise("test")})
    own = t.groupBy("split").agg(F.countDistinct("g").alias("n_groups"), F.count(F.lit(1)).alias("n_scenes"), F.sum("valid_frames").alias("frames"))
    total = own.select(F.sum("frames")).scalar()
    return own.select("split", "n_groups", "n_scenes", "frames", F.round(F.col("frames") / total, 6).alias("share"))


@query("SELECT doc_id % 40 AS visual_group, count(DISTINCT toxic) AS n_splits FROM labels GROUP BY 1 HAVING count(DISTINCT toxic) > 1")
def leak_check(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("visual_group"), "toxic")
    return relational.leaks(rows, "visual_group", "toxic")


HIST = GRID + ", hst AS (SELECT frame, video, idx, list_transform(px, lambda p: p / list_sum(px)) AS h, list_transform(px, lambda p: (255 - p) / list_sum(list_transform(px, lambda q: 255 - q))) AS g FROM grid)"


def histograms(spark, sf_dir) -> DataFrame:
    g = grids(spark, sf_dir)
    return g.select("frame", "video", "idx", "_len", l1_unit("px").alias("h"), l1_unit(F.transform("px", lambda p: 255 - p)).alias("g"))


BHATT = "sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 65), lambda i: sqrt({p}[i] * {q}[i]))) / sqrt(list_sum({p}) * list_sum({q}))))"


@query(f"""{RECURSIVE}{HIST}, lg AS (SELECT *, frame % 29 = 0 AS broken, count(*) OVER (PARTITION BY video) AS n, {', '.join(f'lag(h, {k}) OVER w AS b{k}' for k in range(1, 6))}, lead(h, 1) OVER w AS a1, lead(h, 2) OVER w AS a2,
NOT bool_or(frame % 29 = 0) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS clear, sum((frame % 29 = 0)::INT) OVER w AS run FROM hst WINDOW w AS (PARTITION BY video ORDER BY idx)),
mn AS (SELECT *, CASE WHEN b5 IS NOT NULL THEN list_transform(range(1, 65), lambda i: (b5[i] + b4[i] + b3[i] + b2[i] + b1[i]) / 5) END AS m FROM lg),
ct AS (SELECT video, idx, run, min(idx) FILTER (WHERE NOT broken) OVER (PARTITION BY video, run) AS first, coalesce(NOT broken AND clear AND n - idx > 3 AND {' AND '.join(f"round({BHATT.format(p='m', q=q)}, 9) >= 0.075::DOUBLE" for q in ('h', 'a1', 'a2'))} AND round({BHATT.format(p='b1', q='h')}, 9) < 0.2::DOUBLE, false) AS cand FROM mn),
c AS (SELECT * FROM ct WHERE cand), g AS (SELECT video, run, min(idx) AS cut FROM c WHERE idx - first >= 12 GROUP BY video, run UNION ALL SELECT g.video, g.run, min(c.idx) AS cut FROM g JOIN c ON c.video = g.video AND c.run = g.run AND c.idx >= g.cut + 12 GROUP BY g.video, g.run)
SELECT video, cut FROM g""")
def reframe_cut(spark, sf_dir):
    h = histograms(spark, sf_dir).withColumn("broken", F.col("frame") % 29 == 0)
    h = stretched(h, scenes.REFRAME_HALO)
    h = h.withColumn("_prev", F.lag("h").over(seq.along(CELL)))
    found = scenes.reframe_candidates(h, "h", "broken", F.round(bhattacharyya("_prev", "h"), 9) < 0.2, distance=0.075, key=CELL, total="_len")
    return scenes.reframe_cuts(own_rows(found), "candidate", "broken")


DESC = HIST + """, bins AS (SELECT video, i, avg(h[i]) AS mh, avg(g[i]) AS mg FROM (SELECT video, h, g, unnest(range(1, 65)) AS i FROM hst) GROUP BY video, i),
un AS (SELECT video, i, 0.75::DOUBLE * mh / sqrt(sum(mh * mh) OVER v) AS a, 0.25::DOUBLE * mg / sqrt(sum(mg * mg) OVER v) AS b FROM bins WINDOW v AS (PARTITION BY video)),
flat AS (SELECT video, i - 1 AS bin, a AS x FROM un UNION ALL SELECT video, i + 63, b FROM un), dsc AS (SELECT video, bin, x / sqrt(sum(x * x) OVER (PARTITION BY video)) AS x FROM flat)"""


def descriptors(spark, sf_dir) -> DataFrame:
    return scenes.mean_descriptor(histograms(spark, sf_dir), ["video"], "h", "g")


@query(f"{WITH}{DESC} SELECT video, bin, round(x, 6) AS x FROM dsc")
def mean_descriptor(spark, sf_dir):
    return descriptors(spark, sf_dir).select("video", F.posexplode("descriptor").alias("bin", "x")).select("video", F.col("bin").cast("long").alias("bin"), *r6("x"))


SCENE_DESC = HIST + """, bins AS (SELECT video, scene, i, avg(h[i]) AS mh, avg(g[i]) AS mg FROM (SELECT video, idx // 16 AS scene, h, g, unnest(range(1, 65)) AS i FROM hst) GROUP BY ALL),
un AS (SELECT video, scene, i, 0.75::DOUBLE * mh / sqrt(sum(mh * mh) OVER v) AS a, 0.25::DOUBLE * mg / sqrt(sum(mg * mg) OVER v) AS b FROM bins WINDOW v AS (PARTITION BY video, scene)),
dsc AS (SELECT video, scene, i - 1 AS bin, a AS x FROM un UNION ALL SELECT video, scene, i + 63, b FROM un)"""


@query(f"""{WITH}{SCENE_DESC} SELECT a.video, a.scene AS a, b.scene AS b, round(1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS distance FROM dsc a JOIN dsc b ON a.bin = b.bin AND a.video = b.video AND a.scene < b.scene GROUP BY ALL""")
def pairwise_cosine(spark, sf_dir):
    """All pairs of the scenes of a video; scenes are stretches of 16 frames here, so a video has few."""
    h = histograms(spark, sf_dir).withColumn("scene", seq.block("idx", 16))
    d = scenes.mean_descriptor(h, ["video", "scene"], "h", "g")
    a, b = d.select("video", F.col("scene").alias("a"), F.col("descriptor").alias("x")), d.select("video", F.col("scene").alias("b"), F.col("descriptor").alias("y"))
    return a.join(b, "video").filter("a < b").select("video", "a", "b", F.round(cosine_distance("x", "y"), 6).alias("distance"))


ALLOC = """g AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS i, sum(n) OVER ()::DOUBLE AS total FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)),
r AS (SELECT 0::BIGINT AS i, NULL::INTEGER AS label, NULL::INTEGER AS s, 0::DOUBLE AS f0, 0::DOUBLE AS f1, 0::DOUBLE AS f2
  UNION ALL SELECT i, label, s, f0 + CASE WHEN s = 0 THEN n ELSE 0 END, f1 + CASE WHEN s = 1 THEN n ELSE 0 END, f2 + CASE WHEN s = 2 THEN n ELSE 0 END FROM (
    SELECT g.i, g.label, g.n, f0, f1, f2, CASE WHEN g.i <= 3 THEN (g.i - 1)::INTEGER WHEN (f0 + n) / (total * 0.8::DOUBLE) <= least((f1 + n) / (total * 0.1::DOUBLE), (f2 + n) / (total * 0.1::DOUBLE)) THEN 0
      WHEN (f1 + n) / (total * 0.1::DOUBLE) <= (f2 + n) / (total * 0.1::DOUBLE) THEN 1 ELSE 2 END AS s FROM r JOIN g ON g.i = r.i + 1))"""


def label_groups(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("visual_group")).agg(F.count(F.lit(1)).alias("n")).withColumn("data_set", F.lit("embeddings"))


@query(f"WITH RECURSIVE {ALLOC} SELECT label AS visual_group, CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM r WHERE i > 0")
def greedy_alloc(spark, sf_dir):
    return scenes.greedy_alloc(label_groups(spark, sf_dir), "data_set", "visual_group", "n").select("visual_group", "split")


@query()
def restart_alloc(spark, sf_dir):
    """The best of 2000 searches; their generators are NumPy's, so no SQL."""
    out = scenes.allocate(label_groups(spark, sf_dir), "visual_group", "n")
    return out.select("visual_group", "split", F.round("error", 9).alias("error"))


@query()
def scene_groups(spark, sf_dir):
    """Average linkage of the scenes of each video, scenes being stretches of 16 frames; compared with plain linkage in the tests."""
    h = histograms(spark, sf_dir).withColumn("scene", seq.block("idx", 16))
    return scenes.group_scenes(scenes.mean_descriptor(h, ["video", "scene"], "h", "g"))


GATE = "matches >= 12 AND scale BETWEEN 0.5::DOUBLE AND 2.0::DOUBLE AND coverage >= 0.03::DOUBLE"


@query(f"""{WITH}{SEQ}, m AS (SELECT video, idx, k::BIGINT AS matches, (k % 10) / 10 AS inliers, v / 1000 AS coverage, v / 40 AS scale FROM seq)
SELECT video, idx, CASE WHEN {GATE} THEN matches ELSE 0 END AS matches, CASE WHEN {GATE} THEN round(inliers, 6) ELSE 0 END AS inliers, CASE WHEN matches >= 12 THEN round(coverage, 6) ELSE 0 END AS coverage, CASE WHEN {GATE} THEN round(scale, 6) END AS scale FROM m""")
def geometry_gate(spark, sf_dir):
    s = sequences(spark, sf_dir)
    m = s.select("video", "idx", F.col("k").cast("long").alias("matches"), ((F.col("k") % 10) / 10).alias("inliers"), (F.col("v") / 1000).alias("coverage"), (F.col("v") / 40).alias("scale"))
    ok = (F.col("matches") >= 12) & F.col("scale").between(0.5, 2.0) & (F.col("coverage") >= 0.03)
    return m.select("video", "idx", F.when(ok, F.col("matches")).otherwise(F.lit(0).cast("long")).alias("matches"), F.when(ok, F.round("inliers", 6)).otherwise(0.0).alias("inliers"),
                    F.when(F.col("matches") >= 12, F.round("coverage", 6)).otherwise(0.0).alias("coverage"), F.when(ok, F.round("scale", 6)).alias("scale"))
