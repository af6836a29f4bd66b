"""Queries over sequences: thresholds, rules, neighbours, buckets, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.functions.columns import flag, natural_key
from framestride.operators import classify as rules
from framestride.operators import robust
from framestride.operators import sequence as seq
from framestride.operators.ordered import own_rows, stretched
from framestride.plans.registry import query
from framestride.sources.tables import CELL, CHG, LOOKS, SEQ, sequences, table, with_changes, with_looks
from framestride.storage import Scratch

WITH = "WITH "


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def changes(spark: SparkSession, sf_dir: str, halo: int = 0) -> DataFrame:
    """Changes from frame to frame, in stretches; ``halo`` keeps so many rows around each, with correct changes."""
    rows = with_changes(stretched(sequences(spark, sf_dir), halo + 1), CELL)
    return rows if halo else own_rows(rows)


# ------------------------------------------------------------------ neighbours

NAMES = "SELECT c_custkey, c_mktsegment, (CASE WHEN c_custkey % 3 = 0 THEN 'Frame' ELSE 'frame' END) || (c_custkey % 500)::VARCHAR || '_' || c_nationkey::VARCHAR || '.png' AS name FROM customer"
KEY_SQL = r"list_transform(regexp_extract_all(chr(1) || name, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 24, '0') ELSE lower(p) END)"


@query(f"SELECT c_custkey, c_mktsegment, name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {KEY_SQL}, c_custkey) - 1 AS idx FROM ({NAMES})")
def natural_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Frame").otherwise("frame"), (F.col("c_custkey") % 500).cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".png"))
    return seq.natural_index(c.select("c_custkey", "c_mktsegment", name.alias("name")), "name", "c_mktsegment", "c_custkey")


@query(f"{WITH}{CHG} SELECT video, idx, lead(hs) OVER w AS hs_next, lead(di) OVER w AS di_next, lead(sat) OVER w AS sat_next, lead(v) OVER w AS v_next, lead(k) OVER w AS k_next FROM chg WINDOW w AS (PARTITION BY video ORDER BY idx)")
def lead_metrics(spark, sf_dir):
    cols = ["hs", "di", "sat", "v", "k"]
    return own_rows(seq.with_next(changes(spark, sf_dir, 1), cols, key=CELL)).select("video", "idx", *[f"{c}_next" for c in cols])


@query(f"{WITH}{SEQ} SELECT video, idx, round(abs(v - lag(v) OVER w), 6) AS dv, round(abs(k - lag(k) OVER w), 6) AS dk FROM seq WINDOW w AS (PARTITION BY video ORDER BY idx)")
def lag_diff(spark, sf_dir):
    rows = stretched(sequences(spark, sf_dir), 1)
    return own_rows(rows.select("video", "idx", F.round(seq.change("v", CELL), 6).alias("dv"), F.round(seq.change("k", CELL), 6).alias("dk"), "_mine", "_stretch"))


@query(f"{WITH}{SEQ} SELECT * FROM (SELECT video, idx, frame, lead(frame) OVER w AS frame_target, v, lead(v) OVER w AS v_target FROM seqf WINDOW w AS (PARTITION BY video ORDER BY idx)) WHERE frame_target IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    return own_rows(seq.pairs(stretched(sequences(spark, sf_dir), 1), ["frame", "v"], CELL)).select("video", "idx", "frame", "frame_target", "v", "v_target")


# ------------------------------------------------------------------ thresholds


def _limits_sql(columns: list[str], source: str, low: str = "{c}_median + 6 * {c}_mad", floors: dict | None = None) -> str:
    floors = floors or {}
    own = ", ".join(f"median({c}) AS {c}_median, mad({c}) AS {c}_mad, quantile_cont({c}, 0.975) AS {c}_high" for c in columns)
    out = ", ".join(f"{f'greatest({floors[c]}::DOUBLE, ' if c in floors else '('}{low.format(c=c)}) AS {c}_limit" for c in columns)
    return f"meds AS (SELECT video, {own} FROM {source} GROUP BY video), lim AS (SELECT *, {out} FROM meds)"


@query(f"{WITH}{SEQ} SELECT video, median(v) AS v_median, round(mad(v), 6) AS v_mad, median(k) AS k_median, round(mad(k), 6) AS k_mad FROM seq GROUP BY video")
def median_mad(spark, sf_dir):
    return robust.median_mad(sequences(spark, sf_dir), ["video"], ["v", "k"]).select("video", "v_median", F.round("v_mad", 6).alias("v_mad"), "k_median", F.round("k_mad", 6).alias("k_mad"))


PAIR_LIMIT = "least({c}_high, {c}_median + 8.0::DOUBLE * 1.4826::DOUBLE * greatest({c}_mad, 1e-6::DOUBLE))"


@query(f"{WITH}{CHG}, {_limits_sql(['hs', 'di'], 'chg', PAIR_LIMIT)} SELECT video, round(hs_limit, 6) AS hs_limit, round(di_limit, 6) AS di_limit FROM lim")
def robust_threshold(spark, sf_dir):
    return robust.pair_thresholds(changes(spark, sf_dir), ["video"], ["hs", "di"]).select("video", *r6("hs_limit", "di_limit"))


FLOORS = {"hs": 0.35, "di": 0.15, "sat": 0.12, "stripes_h": None, "stripes_v": None, "blocks": None}
ADAPTIVE = _limits_sql(list(FLOORS), "looks", floors={c: f for c, f in FLOORS.items() if f})


@query(f"{WITH}{LOOKS}, {ADAPTIVE} SELECT video, {', '.join(f'round({c}_limit, 6) AS {c}_limit' for c in FLOORS)} FROM lim")
def adaptive_thresholds(spark, sf_dir):
    return robust.floored_thresholds(with_looks(changes(spark, sf_dir)), ["video"], FLOORS).select("video", *r6(*[f"{c}_limit" for c in FLOORS]))


CUT_FLOORS = {"hs": 0.30, "di": 0.12}
CUT_LIMITS = """meds AS (SELECT video, median(hs) AS hs_median, median(di) AS di_median, greatest(1.4826::DOUBLE * mad(hs), 1e-6::DOUBLE) AS hs_scale, greatest(1.4826::DOUBLE * mad(di), 1e-6::DOUBLE) AS di_scale FROM chg GROUP BY video),
lim AS (SELECT *, greatest(0.30::DOUBLE, hs_median + 6 * hs_scale) AS hs_limit, greatest(0.12::DOUBLE, di_median + 6 * di_scale) AS di_limit FROM meds)"""


@query(f"{WITH}{CHG}, {CUT_LIMITS} SELECT video, {', '.join(f'round({c}_{s}, 6) AS {c}_{s}' for c in CUT_FLOORS for s in ('median', 'scale', 'limit'))} FROM lim")
def cut_thresholds(spark, sf_dir):
    return robust.scaled_thresholds(changes(spark, sf_dir), ["video"], CUT_FLOORS).select("video", *r6(*[f"{c}_{s}" for c in CUT_FLOORS for s in ("median", "scale", "limit")]))


# ------------------------------------------------------------------ pair exclusion and split

EXCLUSION = f"""{CHG}, prs AS (SELECT video, idx - 1 AS idx, round(hs, 9) AS hs, round(di, 9) AS di FROM chg WHERE idx > 0), {_limits_sql(['hs', 'di'], 'prs', PAIR_LIMIT)},
exc AS (SELECT p.video, idx, hs, di, coalesce(hs > round(hs_limit, 9), false) AS excluded_transition, coalesce(di > round(di_limit, 9), false) AS excluded_motion, NOT (coalesce(hs > round(hs_limit, 9), false) OR coalesce(di > round(di_limit, 9), false)) AS valid FROM prs p JOIN lim USING (video)),
spl AS (SELECT *, CASE WHEN NOT valid THEN 'excluida' WHEN sum(valid::INT) OVER (PARTITION BY video ORDER BY idx) % 20 = 0 THEN 'valid' ELSE 'train' END AS split FROM exc)"""


def excluded_pairs(spark, sf_dir) -> DataFrame:
    """Pairs with strict exclusion by robust thresholds."""
    pairs = changes(spark, sf_dir).filter("idx > 0").select("video", (F.col("idx") - 1).alias("idx"), F.round("hs", 9).alias("hs"), F.round("di", 9).alias("di"))
    out = robust.with_pair_limits(Scratch(spark, "pairs").save(pairs), ["video"], ["hs", "di"]).withColumns({"excluded_transition": flag(F.col("hs") > F.round("hs_limit", 9)), "excluded_motion": flag(F.col("di") > F.round("di_limit", 9))})
    return out.withColumn("valid", ~(F.col("excluded_transition") | F.col("excluded_motion"))).drop("hs_limit", "di_limit")


def split_pairs(spark, sf_dir) -> DataFrame:
    return seq.systematic_split(excluded_pairs(spark, sf_dir), "valid")


@query(f"{WITH}{EXCLUSION} SELECT video, idx, hs, di, excluded_transition, excluded_motion, valid FROM exc")
def pair_exclusion(spark, sf_dir):
    return excluded_pairs(spark, sf_dir)


@query(f"{WITH}{EXCLUSION} SELECT video, split, count(*) AS n FROM spl GROUP BY ALL")
def systematic_split(spark, sf_dir):
    return split_pairs(spark, sf_dir).groupBy("video", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}{EXCLUSION} SELECT video, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'excluida') AS excluded FROM spl GROUP BY video")
def class_counts(spark, sf_dir):
    return split_pairs(spark, sf_dir).groupBy("video").agg(*[F.count_if(F.col("split") == s).alias(n) for s, n in (("train", "train"), ("valid", "valid"), ("excluida", "excluded"))])


@query(f"{WITH}{EXCLUSION} SELECT video, idx, split, 'frame_' || lpad(idx::VARCHAR, 7, '0') || '.tif' AS file, hs, di, valid FROM spl")
def project_pairs(spark, sf_dir):
    return split_pairs(spark, sf_dir).select("video", "idx", "split", F.concat(F.lit("frame_"), F.lpad(F.col("idx").cast("string"), 7, "0"), F.lit(".tif")).alias("file"), "hs", "di", "valid")


@query(f"""{WITH}{EXCLUSION} SELECT s.video, count(*) + 1 AS frames, count(*) AS pairs, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'excluida') AS excluded,
round(any_value(hs_limit), 6) AS hs_limit, round(any_value(di_limit), 6) AS di_limit FROM spl s JOIN lim l ON s.video = l.video GROUP BY s.video""")
def prep_summary(spark, sf_dir):
    out = robust.with_pair_limits(split_pairs(spark, sf_dir), ["video"], ["hs", "di"])
    counts = out.groupBy("video").agg(*[F.first(f"{c}_limit").alias(f"{c}_limit") for c in ("hs", "di")], (F.count(F.lit(1)) + 1).alias("frames"), F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col("split") == s).alias(n) for s, n in (("train", "train"), ("valid", "valid"), ("excluida", "excluded"))])
    return counts.select("video", "frames", "pairs", "train", "valid", "excluded", *r6("hs_limit", "di_limit"))


# ------------------------------------------------------------------ rules

NEXT = f"""{LOOKS}, {ADAPTIVE}, n0 AS (
  SELECT looks.*, {', '.join(f'lim.{c}_limit' for c in FLOORS)}, lead(hs) OVER w AS hs_next, lead(di) OVER w AS di_next, lead(sat) OVER w AS sat_next, lead(hs, 2) OVER w AS hs_2, lead(di, 2) OVER w AS di_2, count(*) OVER (PARTITION BY video) AS n
  FROM looks JOIN lim USING (video) WINDOW w AS (PARTITION BY video ORDER BY idx)
)"""
OWN = NEXT + """, s0 AS (
  SELECT *, concat_ws(';', CASE WHEN white >= 0.7::DOUBLE THEN 'fondo_blanco' END, CASE WHEN black >= 0.7::DOUBLE THEN 'fondo_negro' END, CASE WHEN contrast <= 8 OR entropy <= 3 THEN 'frame_uniforme' END,
    CASE WHEN stripes_h >= stripes_h_limit OR stripes_v >= stripes_v_limit THEN 'artefactos_franjas' END, CASE WHEN blocks >= blocks_limit AND entropy < 6 THEN 'artefactos_bloques' END) AS own FROM n0
), s1 AS (SELECT *, own <> '' AS a1, CASE WHEN own <> '' THEN 'transicion' ELSE 'valido' END AS c1, CASE WHEN own <> '' THEN own ELSE 'continuidad' END AS r1 FROM s0)"""


def _mark(old: str, new: str, i: int, where: str, reason: str, kind: str = "'transicion'") -> str:
    """A further state of the chain: rows of ``where`` become anomalous."""
    return f""", {new} AS (SELECT * EXCLUDE (hit), a{i} OR hit AS a{i + 1}, CASE WHEN hit THEN {kind} ELSE c{i} END AS c{i + 1}, CASE WHEN hit THEN {reason} ELSE r{i} END AS r{i + 1}
  FROM (SELECT *, coalesce({where}, false) AS hit FROM {old}))"""


FIRST = OWN + _mark("s1", "s2", 1, "idx = 0 AND (hs_next >= hs_limit OR di_next >= di_limit) AND hs_2 <= 0.18::DOUBLE AND di_2 <= 0.12::DOUBLE", "'inicio_atipico'")
BOTH = "(coalesce(hs >= hs_limit, false) OR coalesce(di >= di_limit, false)) AND (coalesce(hs_next >= hs_limit, false) OR coalesce(di_next >= di_limit, false))"
TWO = FIRST + _mark("s2", "s3", 2, f"NOT a2 AND idx > 0 AND idx < n - 1 AND (({BOTH}) OR (sat >= sat_limit AND sat_next >= sat_limit))", f"CASE WHEN {BOTH} THEN 'difiere_del_anterior_y_del_siguiente' ELSE 'cambio_inestable_de_saturacion' END")
TAIL = TWO + """, t1 AS (
  SELECT *, NOT bool_or(a3) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AND bool_and(coalesce(hs_next <= 0.18::DOUBLE AND di_next <= 0.12::DOUBLE, false)) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AND idx + 3 < n AS st FROM s3
), t2 AS (
  SELECT *, max(CASE WHEN a3 THEN idx END) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seed, max(CASE WHEN st THEN idx END) OVER (PARTITION BY video ORDER BY idx) AS calm FROM t1
)""" + _mark("t2", "s4", 3, "NOT a3 AND idx - seed <= 4 AND idx <= n - 4 AND (calm IS NULL OR calm < seed)", "'cola_transicion_inestable'")


def _gap(old: str, new: str, i: int) -> str:
    return f", g{i} AS (SELECT *, lag(a{i}) OVER w AND lead(a{i}) OVER w AS mid{i} FROM {old} WINDOW w AS (PARTITION BY video ORDER BY idx))" + _mark(f"g{i}", new, i, f"NOT a{i} AND mid{i}", "'entre_frames_anomalos'")


GAP = TAIL + _gap("s4", "s5", 4)
ZOOM = GAP + _mark("s5", "s6", 5, "NOT a5 AND idx > 0 AND matches >= 20 AND inliers >= 0.35::DOUBLE AND scale IS NOT NULL AND abs(ln(scale)) >= 0.04::DOUBLE", "printf('cambio_escala_%.3f', scale)", "'zoom'")
CLASSIFIED = ZOOM + _gap("s6", "s7", 6)


def states(spark, sf_dir, upto: int) -> DataFrame:
    """The chain up to a rule: own, first frame, two sides, tail, gap, zoom, gap."""
    # what the rules read is saved in stretches: thresholds and rules both start from it
    looks = Scratch(spark, "looks").save(with_looks(changes(spark, sf_dir, rules.HALO)))
    looks = robust.beside(looks, robust.floored_thresholds(looks.filter("_mine"), ["video"], FLOORS), ["video"])
    c = rules.Columns(CELL, total="_len")
    if upto == 7:
        return own_rows(rules.classify(looks, c=c))
    out = looks.withColumns({f"{x}_next": F.lead(x).over(seq.along(CELL)) for x in ("hs", "di", "sat")})
    lim = {x: F.col(f"{x}_limit") for x in FLOORS}
    out = rules.start(out, rules.own_reasons(lim["stripes_h"], lim["stripes_v"], lim["blocks"]))
    steps = [lambda d: rules.first_frame(d, lim["hs"], lim["di"], c), lambda d: rules.two_sided(d, lim["hs"], lim["di"], lim["sat"], c), lambda d: rules.tail_extension(d, c), lambda d: rules.gap_fill(d, c), lambda d: rules.zoom(d, c)]
    for step in steps[: upto - 1]:
        out = step(out)
    return own_rows(out)


def _state_sql(text: str, name: str, i: int) -> str:
    return f"{WITH}{text} SELECT video, idx, a{i} AS anomaly, c{i} AS class, r{i} AS reason FROM {name}"


OUT = ["video", "idx", "anomaly", "class", "reason"]


@query(_state_sql(OWN, "s1", 1))
def own_anomaly(spark, sf_dir):
    return states(spark, sf_dir, 1).select(*OUT)


@query(_state_sql(FIRST, "s2", 2))
def first_frame(spark, sf_dir):
    return states(spark, sf_dir, 2).select(*OUT)


@query(_state_sql(TWO, "s3", 3))
def two_sided(spark, sf_dir):
    return states(spark, sf_dir, 3).select(*OUT)


@query(_state_sql(TAIL, "s4", 4))
def tail_extension(spark, sf_dir):
    return states(spark, sf_dir, 4).select(*OUT)


@query(_state_sql(GAP, "s5", 5))
def gap_fill(spark, sf_dir):
    return states(spark, sf_dir, 5).select(*OUT)


@query(_state_sql(ZOOM, "s6", 6))
def zoom_rule(spark, sf_dir):
    return states(spark, sf_dir, 6).select(*OUT)


@query(_state_sql(CLASSIFIED, "s7", 7))
def frame_class(spark, sf_dir):
    return states(spark, sf_dir, 7).select(*OUT)


@query(f"""{WITH}{CLASSIFIED} SELECT video, class, idx, v FROM (SELECT video, c7 AS class, idx, v, row_number() OVER (PARTITION BY video, c7 ORDER BY round(coalesce(hs, 0) + coalesce(di, 0), 9) DESC, idx) AS r FROM s7) WHERE r = 1""")
def class_example(spark, sf_dir):
    scored = states(spark, sf_dir, 7).withColumn("_score", F.round(F.coalesce("hs", F.lit(0.0)) + F.coalesce("di", F.lit(0.0)), 9))
    return seq.best_per(scored, "_score", ["video", "class"]).select("video", "class", "idx", "v")


# ------------------------------------------------------------------ blocks, buckets, sampling


@query(f"{WITH}{SEQ} SELECT video, idx, idx // 250 AS block_250, idx // 80 AS block_80, idx // 16 AS block_16 FROM seq")
def block_id(spark, sf_dir):
    return sequences(spark, sf_dir).select("video", "idx", *[seq.block("idx", n).alias(f"block_{n}") for n in (250, 80, 16)])


@query(f"""{WITH}{SEQ}, m AS (SELECT *, max(idx) OVER (PARTITION BY video) AS last FROM seq), b AS (SELECT video, idx, unnest(range(greatest(0, idx - 10) // 80, least(last // 80, (idx + 10) // 80) + 1)) AS block FROM m)
SELECT video, block, count(*) AS frames, count(*) FILTER (WHERE idx // 80 = block) AS center, min(idx) AS first_idx, max(idx) AS last_idx FROM b GROUP BY ALL""")
def block_halo(spark, sf_dir):
    out = seq.with_halo(sequences(spark, sf_dir).select("video", "idx"), 80, 10)
    return out.groupBy("video", "block").agg(F.count(F.lit(1)).alias("frames"), F.count_if("is_center").alias("center"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query(f"{WITH}{SEQ} SELECT video, idx % 7 AS part, count(*) AS n, min(idx) AS first_idx, round(sum(v), 4) AS total FROM seq GROUP BY ALL")
def round_robin(spark, sf_dir):
    out = sequences(spark, sf_dir).withColumn("part", seq.round_robin("idx", 7))
    return out.groupBy("video", "part").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.round(F.sum("v"), 4).alias("total"))


BUCKETS = f"""{CHG}, bkt AS (SELECT * EXCLUDE (r, n), (SELECT max(j) FROM range(5) t(j) WHERE floor(j * n / 5) <= r) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY video) AS n FROM chg))"""
NORM = BUCKETS + ", nrm AS (SELECT *, " + ", ".join(
    f"CASE WHEN max(coalesce({c}, 0)) OVER b > min(coalesce({c}, 0)) OVER b THEN (coalesce({c}, 0) - min(coalesce({c}, 0)) OVER b) / (max(coalesce({c}, 0)) OVER b - min(coalesce({c}, 0)) OVER b) ELSE 0 END AS n_{c}" for c in ("v", "k", "hs")) + " FROM bkt WINDOW b AS (PARTITION BY video, bucket))"


def normed(spark, sf_dir) -> DataFrame:
    return seq.with_minmax(seq.time_buckets(changes(spark, sf_dir)), ["v", "k", "hs"], ["video", "bucket"])


@query(f"{WITH}{BUCKETS} SELECT video, bucket, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM bkt GROUP BY ALL")
def time_buckets(spark, sf_dir):
    return seq.time_buckets(sequences(spark, sf_dir)).groupBy("video", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query(f"{WITH}{NORM} SELECT video, idx, bucket, round(n_v, 6) AS n_v, round(n_k, 6) AS n_k, round(n_hs, 6) AS n_hs FROM nrm")
def minmax_norm(spark, sf_dir):
    return normed(spark, sf_dir).select("video", "idx", "bucket", *r6("n_v", "n_k", "n_hs"))


@query(f"""{WITH}{NORM}, b AS (SELECT *, round(0.5::DOUBLE * n_v + 0.3::DOUBLE * n_k + 0.2::DOUBLE * n_hs, 9) AS score FROM nrm)
SELECT video, bucket, idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video, bucket ORDER BY score DESC, idx) AS r FROM b) WHERE r = 1""")
def top1_bucket(spark, sf_dir):
    scored = normed(spark, sf_dir).withColumn("score", F.round(0.5 * F.col("n_v") + 0.3 * F.col("n_k") + 0.2 * F.col("n_hs"), 9))
    return seq.best_per(scored, "score", ["video", "bucket"]).select("video", "bucket", "idx", *r6("score"))


VIDEOS_SQL = "SELECT n_nationkey AS video, (CASE n_nationkey % 3 WHEN 0 THEN 30.0 WHEN 1 THEN 29.97 ELSE 25.0 END)::DOUBLE AS fps, (3000 + n_nationkey * 7)::BIGINT AS total, (n_nationkey / 2)::DOUBLE AS b, (n_nationkey / 2 + 61.3)::DOUBLE AS u, (CASE n_nationkey % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 12.0 WHEN 2 THEN 30.0 ELSE 40.0 END)::DOUBLE AS fo FROM nation"


@query(f"""WITH v AS ({VIDEOS_SQL}), i AS (SELECT *, greatest(0, ceil(b * fps))::BIGINT AS first, least(total, ceil(u * fps))::BIGINT AS past, ceil((u - b) * fo - 1e-9)::BIGINT AS n FROM v),
e AS (SELECT video, unnest(range(first, past)) AS s FROM i WHERE abs(fo - fps) <= 1e-9), o AS (SELECT video, least(greatest(round_even((b + p / fo) * fps, 0)::BIGINT, first), past - 1) AS s FROM (SELECT *, unnest(range(n)) AS p FROM i WHERE abs(fo - fps) > 1e-9)),
a AS (SELECT * FROM e UNION SELECT * FROM o) SELECT video, row_number() OVER (PARTITION BY video ORDER BY s) - 1 AS position, s AS source_idx FROM a""")
def fps_resample(spark, sf_dir):
    k = F.col("n_nationkey")
    fps = F.when(k % 3 == 0, 30.0).when(k % 3 == 1, 29.97).otherwise(25.0)
    out = F.when(k % 4 == 0, 5.0).when(k % 4 == 1, 12.0).when(k % 4 == 2, 30.0).otherwise(40.0)
    v = table(spark, sf_dir, "nation").select(k.alias("video"), fps.alias("fps"), (3000 + k * 7).cast("long").alias("total"), (k / 2).alias("begin"), (k / 2 + 61.3).alias("until"), out.alias("fps_out"))
    return seq.resample(v).select("video", "position", "source_idx")


@query(f"{WITH}{SEQ} SELECT video, idx, round(12.5::DOUBLE + idx / 5.0::DOUBLE, 6) AS seconds FROM seq")
def frame_seconds(spark, sf_dir):
    return sequences(spark, sf_dir).select("video", "idx", F.round(12.5 + F.col("idx") / 5.0, 6).alias("seconds"))


@query(f"{WITH}{SEQ} SELECT video, idx, v FROM seq ORDER BY video, idx")
def sort_pos(spark, sf_dir):
    return sequences(spark, sf_dir).select("video", "idx", "v").orderBy("video", "idx")


@query(f"""{WITH}{SEQ} SELECT video, arg_min(idx, (v, idx)) AS low_idx, min(v) AS low, arg_max(idx, (v, -idx)) AS high_idx, max(v) AS high FROM seq GROUP BY video""")
def extreme_rows(spark, sf_dir):
    s = sequences(spark, sf_dir).groupBy("video").agg(F.min(F.struct("v", "idx")).alias("lo"), F.max(F.struct(F.col("v"), (-F.col("idx")).alias("i"))).alias("hi"))
    return s.select("video", F.col("lo.idx").alias("low_idx"), F.col("lo.v").alias("low"), (-F.col("hi.i")).alias("high_idx"), F.col("hi.v").alias("high"))
