"""Operator 3, mixing sources to target weights: hash-threshold histograms.

A document's place in its source's order is a 48-bit hash of its id and text, then,
among equal rows, one of the row's number. Word counts are summed by source and the
hash's leading 12 bits; the running sum over those at most 4096 sums finds the bucket
in which the source's budget ends; only that bucket is summed again by the next 12
bits, and so on for four levels. What lies below the threshold is taken, and the row
at it if that brings the sum nearer to the budget; so no document is ever sorted, and
a larger budget takes all that a smaller one takes (nested). Where several rows share
the hash at the threshold (equal rows), they alone go through four more levels by the
hash of their numbers. A source with a third of all rows is summed map-side like any
other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.llm.common import WS, Scratch, pick, table, with_row_ids
from framestride.operators.ordered import numbered

LEVELS, BITS = 4, 12
#: Sources by code point, null last, weigh so, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MAX_REPEAT = 3


def mix_hash(doc_id: Column, text: Column) -> Column:
    """The 48 leading bits of the MD5 of the id, a space and the text (null: empty)."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 12), 16, 10).cast("long")


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS}]+")).cast("long")


def tie_hash(number: Column) -> Column:
    """48 bits that part rows which are equal, from a number of their own."""
    return F.xxhash64(number).bitwiseAND(F.lit((1 << 48) - 1))


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """``_source, _source_size, _target``: the total shared by weight; a source above ``cap`` times
    its size stops there and the excess is shared anew among the rest, until none is above.

    ``sizes``: ``_source, _n``, one row for each source. Sources without words get 0.
    Only sums over the sources come to the driver, once a round.
    """
    rank = numbered(sizes, [F.col("_source").asc_nulls_last()], scratch, index="_rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    rows = scratch.save(rank.select("_source", F.col("_n").alias("_source_size"), weight.alias("_w")))
    most = F.lit(cap) * F.col("_source_size")
    share, free = None, -1
    while True:
        # a share of all that is left: what it would give a source above its cap is more than the source may take
        over = F.lit(False) if share is None else F.lit(share[0]) * F.col("_w") / F.lit(share[1]) > most
        r = rows.agg(F.sum("_source_size").alias("total"), F.coalesce(F.sum(F.when(over, most)), F.lit(0)).alias("capped"), F.sum(F.when(~over, F.col("_w"))).alias("whole"), F.count_if(~over).alias("free")).first()
        if r["free"] in (0, free):
            break
        share, free = (float(r["total"] - r["capped"]), r["whole"]), r["free"]
    if share is None:
        return rows.select("_source", "_source_size", F.lit(0.0).alias("_target"))
    even = F.lit(share[0]) * F.col("_w") / F.lit(share[1])
    return rows.select("_source", "_source_size", F.least(even, most.cast("double")).alias("_target"))


def descend(rows: DataFrame, plan: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``_source, _left, _at`` for each source of ``plan`` (``_source, _budget``): the first value of
    ``key`` with which the words pass the budget and what is left of it before; ``_left`` is
    -1 where all rows fit.
    """
    state = plan.select("_source", F.col("_budget").alias("_left"), F.lit(0).cast("long").alias("_at"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows
        if level:
            # the boundary bucket alone
            inside = rows.join(state.select(F.col("_source").alias("_s"), "_at", "_left"), F.col("_source").eqNullSafe(F.col("_s"))).filter(
                (F.col("_left") >= 0) & (F.shiftright(key, shift + BITS) == F.shiftright("_at", shift + BITS))).drop("_s", "_at", "_left")
        sums = inside.groupBy("_source", F.shiftright(key, shift).alias("_b")).agg(F.sum("_size").alias("_n"))
        run = sums.withColumn("_run", F.sum("_n").over(W.partitionBy("_source").orderBy("_b")))
        joined = run.select(F.col("_source").alias("_s"), "_b", "_run").join(state, F.col("_s").eqNullSafe(F.col("_source")), "right")
        fits = F.col("_run") <= F.col("_left")
        # the first bucket that doesn't fit is the boundary
        stop = joined.groupBy("_source", "_left", "_at").agg(F.min(F.when(~fits, F.col("_b"))).alias("_stop"), F.coalesce(F.max(F.when(fits, F.col("_run"))), F.lit(0).cast("long")).alias("_used"))
        over = (F.col("_left") < 0) | F.col("_stop").isNull()
        # one row for each source: saved, so that the planner knows its size and broadcasts it where that is small
        state = scratch.save(stop.select("_source", F.when(over, F.lit(-1.0)).otherwise(F.col("_left") - F.col("_used")).alias("_left"), F.when(over, F.lit(0).cast("long")).otherwise(F.shiftleft("_stop", shift)).alias("_at")))
    return state


ALL = (1 << 48) + 1


def thresholds(slim: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """``_source, _below, _tie_below`` for each source of ``plan`` (``_source, _budget``).

    Rows of ``slim`` (``_source, _size, _hash, _tie``) are taken once more if their hash is
    below, or equal and their tie below. The row at which the budget ends is taken if the
    sum with it is nearer to the budget than the sum without.
    """
    first = descend(slim, plan, "_hash", scratch)
    edge = slim.join(first.select(F.col("_source").alias("_s"), "_left", "_at"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_at")) & (F.col("_left") >= 0))
    sums = scratch.save(edge.groupBy("_source", "_left", "_at").agg(F.sum("_size").alias("_n"), F.count(F.lit(1)).alias("_rows")))
    ended = first.filter("_left < 0").select("_source", F.lit(ALL).cast("long").alias("_below"), F.lit(0).cast("long").alias("_tie_below"))
    nearer = F.when(F.col("_n") - F.col("_left") < F.col("_left"), F.lit(ALL).cast("long")).otherwise(F.lit(0).cast("long"))
    alone = sums.filter("_rows = 1").select("_source", F.col("_at").alias("_below"), nearer.alias("_tie_below"))
    equal = sums.filter("_rows > 1")
    out = ended.unionAll(alone)
    if equal.limit(1).count():
        # rows of one hash, which are equal rows: the same walk by their own numbers
        rows = edge.join(equal.select(F.col("_source").alias("_q")), F.col("_source").eqNullSafe(F.col("_q"))).select("_source", "_size", "_tie")
        second = descend(rows, equal.select("_source", F.col("_left").alias("_budget")), "_tie", scratch)
        last = rows.join(second.select(F.col("_source").alias("_s"), F.col("_left").alias("_rest"), F.col("_at").alias("_place")), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_tie") == F.col("_place")) & (F.col("_rest") >= 0))
        last = last.groupBy(F.col("_source").alias("_s"), "_rest", "_place").agg(F.sum("_size").alias("_more"))
        with_last = F.col("_more") - F.col("_rest") < F.col("_rest")
        ties = equal.join(last, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
            "_source", F.col("_at").alias("_below"), F.when(F.col("_place").isNull(), F.lit(ALL).cast("long")).otherwise(F.col("_place") + with_last.cast("long")).alias("_tie_below"))
        out = out.unionAll(ties)
    return out


def mix_plan(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each source: ``_s, _source_size, _target, _whole`` (full passes), ``_below, _tie_below``."""
    sizes = slim.groupBy("_source").agg(F.sum("_size").alias("_n"))
    want = targets(sizes, scratch)
    whole = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("int")
    plan = want.withColumn("_whole", whole).withColumn("_budget", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    below = thresholds(slim, plan.select("_source", "_budget"), scratch).withColumnRenamed("_source", "_t")
    return scratch.save(plan.join(below, F.col("_source").eqNullSafe(F.col("_t")), "left").select(
        F.col("_source").alias("_s"), "_source_size", "_target", "_whole", "_below", "_tie_below"))


def with_copies(df: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """``df`` (with ``_hash, _tie``) beside its source's plan, and ``_copies``, how often the mix takes the row."""
    taken = (F.col("_hash") < F.col("_below")) | ((F.col("_hash") == F.col("_below")) & (F.col("_tie") < F.col("_tie_below")))
    return df.join(plan, F.col(source).eqNullSafe(F.col("_s")), "left").withColumn("_copies", F.least(F.lit(MAX_REPEAT), F.col("_whole") + taken.cast("int")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it.

    Null and empty texts have size 0; very long ones are counted whole; a null
    source is a source of its own, last in order; null and repeated ids stand
    apart by their texts, and of rows equal in both as many are taken as come nearest
    to the target; an empty table gives none; further columns don't matter. Taken
    words are off the target by at most half of the document at which the budget ends,
    whatever the sizes are.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    scratch = Scratch(spark, "op3")
    slim = scratch.save(docs.select("doc_id", F.col("source").alias("_source"), words_in(F.col("text")).alias("_size"), mix_hash(F.col("doc_id"), F.col("text")).alias("_hash"), tie_hash(F.monotonically_increasing_id()).alias("_tie")))
    out = with_copies(slim, mix_plan(slim, scratch), "_source")
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.round("_target", 4).alias("target"),
                      (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, stored: bool = False) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it (0 to 3 times).

    Nulls, ties and repeated rows as in ``op3_mixing``; an empty table gives none;
    all columns are kept whatever their names. ``stored``: ``docs`` is a Parquet
    table as read.
    """
    scratch = Scratch(spark, "mix")
    rows, kept = with_row_ids(docs, scratch, stored, "doc_id", "source", "text")
    rows = rows.withColumns({"_hash": mix_hash(F.col("_doc_id"), F.col("_text")), "_tie": tie_hash(F.col("_node"))})
    slim = scratch.save(rows.select("_source", words_in(F.col("_text")).alias("_size"), "_hash", "_tie"))
    out = with_copies(rows, mix_plan(slim, scratch), "_source")
    return out.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*kept).toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 12))::BIGINT AS h FROM documents
), s AS (
  SELECT source, n, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)
), r AS (
  SELECT source, n, w, NULL::DOUBLE AS capped, sum(n) OVER ()::DOUBLE AS remaining, sum(w) OVER () AS whole, 0 AS i FROM s
  UNION ALL
  SELECT source, n, w, c, total - sum(coalesce(c, 0)) OVER (), sum(CASE WHEN c IS NULL THEN w ELSE 0 END) OVER (), i + 1
  FROM (SELECT *, sum(n) OVER ()::DOUBLE AS total, CASE WHEN capped IS NOT NULL OR remaining * w / whole > 3 * n THEN (3 * n)::DOUBLE END AS c,
        max(CASE WHEN capped IS NULL AND remaining * w / whole > 3 * n THEN 1 ELSE 0 END) OVER () AS more FROM r)
  WHERE more = 1
), t AS (
  SELECT source, n, coalesce(capped, remaining * w / whole) AS target FROM r WHERE i = (SELECT max(i) FROM r)
), p AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(target / n) END::BIGINT AS passes FROM t
), o AS (
  SELECT d.*, p.n, p.target, p.passes, sum(size) OVER (PARTITION BY d.source ORDER BY h, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), e AS (SELECT *, target - passes * n AS budget FROM o),
-- the first row that passes the budget is taken where that is nearer
f AS (SELECT *, run <= budget OR (run - size <= budget AND run - budget < budget - (run - size)) AS more FROM e)
SELECT doc_id, size, n AS source_size, round(target, 4) AS target, (size * (passes + more::INT))::BIGINT AS taken FROM f
"""
