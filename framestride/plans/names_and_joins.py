"""Queries over names, joins, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.functions import columns as cols
from framestride.operators import inference, relational, summary
from framestride.plans.registry import query
from framestride.plans.sequence_queries import changes, r6
from framestride.sources.tables import CHG, SEQ, sequences, table

WITH = "WITH "


@query("SELECT l_orderkey, l_linenumber, code, chr((code & 255)::INT) || chr(((code >> 8) & 255)::INT) || chr(((code >> 16) & 255)::INT) || chr(((code >> 24) & 255)::INT) AS fourcc FROM (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (65 + l_orderkey % 26) + (65 + l_partkey % 26) * 256 + (48 + l_suppkey % 10) * 65536 + (48 + l_linenumber % 10)::BIGINT * 16777216 AS code FROM lineitem)")
def fourcc_decode(spark, sf_dir):
    c = F.col
    code = (65 + c("l_orderkey") % 26) + (65 + c("l_partkey") % 26) * 256 + (48 + c("l_suppkey") % 10) * 65536 + (48 + c("l_linenumber") % 10).cast("long") * 16777216
    return table(spark, sf_dir, "lineitem").select("l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), code.alias("code")).withColumn("fourcc", cols.fourcc("code"))


#: Names of files made from customers, with several extensions, folders and digits.
FILES = r"""files AS (SELECT c_custkey AS id, 'dir.' || (c_custkey % 7)::VARCHAR || '/' || (CASE c_custkey % 5 WHEN 0 THEN 'frame_' || c_custkey::VARCHAR || '.PNG' WHEN 1 THEN 'a12b' || c_custkey::VARCHAR || '.tar.jpg' WHEN 2 THEN 'noise.txt' WHEN 3 THEN '.hidden' ELSE 'x' || c_custkey::VARCHAR || '.Tiff' END) AS path FROM customer)"""


def files(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("frame_"), s, F.lit(".PNG"))).when(k % 5 == 1, F.concat(F.lit("a12b"), s, F.lit(".tar.jpg"))).when(k % 5 == 2, "noise.txt").when(k % 5 == 3, ".hidden").otherwise(F.concat(F.lit("x"), s, F.lit(".Tiff")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("dir."), (k % 7).cast("string"), F.lit("/"), name).alias("path"))


@query(f"{WITH}{FILES}, n AS (SELECT id, path, string_split(path, '/')[-1] AS name FROM files) SELECT id, path, lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) AS ext, CASE WHEN regexp_matches(name, '.\\.[^.]*$') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem FROM n WHERE lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff')")
def ext_filter(spark, sf_dir):
    f = files(spark, sf_dir).withColumns({"ext": cols.extension("path"), "stem": cols.stem("path")})
    return f.filter(F.col("ext").isin(".png", ".jpg", ".jpeg", ".tif", ".tiff")).select("id", "path", "ext", "stem")


@query(f"{WITH}{FILES} SELECT id, coalesce(try_cast(regexp_extract_all(string_split(path, '/')[-1], '\\d+')[-1] AS BIGINT), -1) AS number FROM files")
def frame_index_parse(spark, sf_dir):
    return files(spark, sf_dir).select("id", cols.last_number(cols.base_name("path")).alias("number"))


@query(f"{WITH}{SEQ}, n AS (SELECT *, count(*) OVER (PARTITION BY video) AS n FROM seq) SELECT video, idx, 'frame_' || lpad(idx::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') || '.png' AS name FROM n")
def frame_name(spark, sf_dir):
    from pyspark.sql import Window as W

    s = sequences(spark, sf_dir).withColumn("n", F.col("_len"))
    return s.select("video", "idx", cols.frame_name("idx", "n").alias("name"))


@query(f"""{WITH}{FILES} SELECT id, text, try_cast(text AS DOUBLE) AS value FROM (SELECT id, CASE id % 4 WHEN 0 THEN (id / 8)::VARCHAR WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' ELSE '' END AS text FROM files) WHERE isfinite(try_cast(text AS DOUBLE))""")
def clean_cast(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 == 0, (k / 8).cast("string")).when(k % 4 == 1, "n/a").when(k % 4 == 2, "NaN").otherwise("").alias("text"))
    return raw.withColumn("value", cols.finite(F.col("text").try_cast("double"))).filter("value IS NOT NULL")


@query(f"""{WITH}{FILES}, d AS (SELECT regexp_extract(path, '^(.*)/', 1) AS dir, count(*) AS n FROM files GROUP BY 1) SELECT dir, n FROM d WHERE n = (SELECT count(*) FROM files WHERE id % 7 = 3) ORDER BY CASE WHEN lower(dir) = 'frames' THEN 0 ELSE 1 END, length(dir), dir LIMIT 1""")
def dir_pick(spark, sf_dir):
    f = files(spark, sf_dir)
    expected = f.filter(F.col("id") % 7 == 3).count()
    dirs = f.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == expected)
    # the feature is one folder
    return dirs.orderBy(F.when(F.lower("dir") == "frames", 0).otherwise(1), F.length("dir"), "dir").limit(1)


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def error_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "event_type", "value")
    # the feature is a short report
    return e.orderBy("event_id").limit(20)


# ------------------------------------------------------------------ joins


@query(f"{WITH}{CHG} SELECT s.video, s.idx, s.v, round(c.hs, 6) AS hs, round(c.di, 6) AS di FROM seq s LEFT JOIN (SELECT video, idx, hs, di FROM chg WHERE idx > 0) c ON s.video = c.video AND s.idx = c.idx")
def left_join_pairs(spark, sf_dir):
    pairs = changes(spark, sf_dir).filter("idx > 0").select("video", "idx", *r6("hs", "di"))
    return sequences(spark, sf_dir).select("video", "idx", "v").join(pairs, ["video", "idx"], "left")


@query("SELECT doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def one_to_one_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return relational.one_to_one(docs, table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "n_chars", "quality", "toxic")


@query("SELECT d.doc_id, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join_metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def missing_clean_anti(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return relational.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), good, ["doc_id"])


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def semi_both(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return relational.in_both(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), l.filter("quality = 1"), l.filter("toxic = 0"), ["doc_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def pending_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.missing(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), done, ["o_orderkey"])


NAMES = f"{SEQ}, a AS (SELECT idx, frame FROM seqf WHERE video = 'click'), b AS (SELECT idx, CASE WHEN idx % 13 = 0 THEN 'x' || frame ELSE frame END AS frame FROM seqf WHERE video = 'view')"


@query(f"{WITH}{NAMES} SELECT idx, a.frame AS left_name, b.frame AS right_name FROM a FULL JOIN b USING (idx) WHERE a.frame IS DISTINCT FROM b.frame")
def full_outer_mismatch(spark, sf_dir):
    s = sequences(spark, sf_dir)
    b = s.filter("video = 'view'").withColumn("frame", F.when(F.col("idx") % 13 == 0, F.concat(F.lit("x"), "frame")).otherwise(F.col("frame")))
    return relational.mismatches(s.filter("video = 'click'"), b, "idx", "frame")


# ------------------------------------------------------------------ orders, sets and upserts

STAGES = ["view", "click", "purchase", "error"]
_RANK = "CASE stage WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"
OLD = "SELECT event_type AS stage, count(*) AS frames, round(avg(value), 4) AS mean FROM events WHERE user_id % 2 = 0 GROUP BY 1"
NEW = "SELECT * FROM (SELECT event_type AS stage, count(*) AS frames, round(avg(value), 4) AS mean FROM events WHERE user_id % 2 = 1 GROUP BY 1) WHERE stage IN ('click', 'error')"


def _stages(spark, sf_dir, parity: int):
    e = table(spark, sf_dir, "events").filter(F.col("user_id") % 2 == parity)
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH o AS ({OLD}), n AS ({NEW}), u AS (SELECT * FROM o WHERE stage NOT IN (SELECT stage FROM n) UNION ALL SELECT * FROM n) SELECT stage, frames, mean, row_number() OVER (ORDER BY {_RANK}, stage) AS place FROM u")
def upsert_summary(spark, sf_dir):
    new = _stages(spark, sf_dir, 1).filter(F.col("stage").isin("click", "error"))
    return relational.upsert_rows(_stages(spark, sf_dir, 0), new, "stage", STAGES)


@query(f"SELECT stage, frames, row_number() OVER (ORDER BY {_RANK}, stage) AS place FROM (SELECT event_type AS stage, count(*) AS frames FROM events GROUP BY 1)")
def custom_order(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("frames"))
    return relational.ranked(counts, "stage", STAGES)


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT stage, o.frames AS frames, n.mean AS mean FROM (SELECT stage, frames FROM o) o FULL JOIN (SELECT stage, mean FROM n) n USING (stage)")
def upsert_stage(spark, sf_dir):
    new = _stages(spark, sf_dir, 1).filter(F.col("stage").isin("click", "error")).select("stage", "mean")
    return relational.upsert_column(_stages(spark, sf_dir, 0), new, "stage")


@query("SELECT l_orderkey FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey").subtract(l.filter("l_returnflag = 'R'").select("l_orderkey"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def topk_groups(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # the feature is a top-k report
    return counts.orderBy(F.desc("n"), "user_id").limit(20)


@query("""WITH e AS (SELECT source, count(*) AS expected FROM documents GROUP BY 1), f AS (SELECT source, count(*) AS found FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, expected, coalesce(found, 0) AS found, expected = coalesce(found, 0) AS complete FROM e LEFT JOIN f USING (source)""")
def completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return inference.completeness(docs, found, ["source"])


FINITE = """SELECT '{c}' AS metric, count(*) FILTER (WHERE isnan({c})) AS n_nan, count(*) FILTER (WHERE isinf({c})) AS n_infinite, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM e"""


@query(f"""WITH e AS (SELECT value, CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE ELSE value END AS weights, CASE WHEN event_id % 5 > 0 THEN value END AS bias FROM events)
{' UNION ALL '.join(FINITE.format(c=c) for c in ('value', 'weights', 'bias'))}""")
def finite_check(spark, sf_dir):
    """Values of each column that aren't finite; a third of one column is made so first."""
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 101 == 0, float("inf")).otherwise(F.col("value"))
    return summary.non_finite(e.select("value", v.alias("weights"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("bias")), ["value", "weights", "bias"])
