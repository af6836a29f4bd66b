"""Operator 4, sharding: a lookup table filled by permutations.

Each shard has a preference order over the slots of a table of prime size,
``(offset + j * skip) mod M`` from two hashes of its name. Shards take turns in
order, each claiming the first free slot of its preference, until the table is
full: slots per shard differ by one at most, and a lost shard moves few slots
beside its own. The table depends on the shards' names alone (``slots`` rows,
set beforehand), so it is broadcast, and placing a document is one hash and one
lookup. Equal ids go to one shard; a null id counts as empty text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import guarded, pick, table

SHARDS = 32
#: Prime, over 100 times the number of shards, so that loads differ by under 1 %.
SLOTS = 4099
#: Tables above this size are refused: they would no longer be small to broadcast.
MAX_SLOTS = 1_000_003


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in ``names``."""
    if not names or len(names) > slots or slots > MAX_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime of at least the number of shards, and not above MAX_SLOTS")
    offset = [_hash(n) % slots for n in names]
    skip = [_hash(n + "#") % (slots - 1) + 1 for n in names]
    table_, at, filled = [-1] * slots, list(offset), 0
    while filled < slots:
        for i in range(len(names)):
            while table_[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table_[at[i]] = i
            filled += 1
            if filled == slots:
                break
    return table_


def slot_of(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``_slot`` and ``_shard`` (its position in ``names``)."""
    spark = rows.sparkSession
    filled = spark.range(1).select(F.posexplode(F.lit(lookup_table(names, slots))).alias("_at", "_shard"))
    return rows.withColumn("_slot", slot_of(F.col(key), slots)).join(F.broadcast(filled), F.col("_slot") == F.col("_at"), "inner").drop("_at")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot, shard number and shard name.

    Null ids share a shard, ties and repeated rows too; texts are not read, so
    null, empty and very long ones make no difference; an empty table gives no
    rows; further columns don't matter.
    """
    docs = pick(table(spark, sf_dir, "documents"), "doc_id")
    return place(docs, "doc_id", shard_names()).select(
        "doc_id", F.col("_slot").alias("slot"), F.col("_shard").cast("long").alias("shard"), F.format_string("shard-%05d", "_shard").alias("shard_name"))


def shard(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents with the number of their shard (``shard``).

    A column that is already called so is replaced.
    """
    rows, kept = guarded(docs, "doc_id")
    names = docs.columns
    own = [(k, n) for k, n in zip(kept, names, strict=True) if n.lower() != "shard"]
    out = place(rows, "_doc_id", shard_names())
    return out.select(*[F.col(k) for k, _ in own], F.col("_shard").cast("long")).toDF(*[n for _, n in own], "shard")


#: One recursive step for each claim, in turn order.
SQL = r"""
WITH RECURSIVE s AS (
  SELECT i, ('0x' || substr(md5(n), 1, 12))::BIGINT % 4099 AS o, ('0x' || substr(md5(n || '#'), 1, 12))::BIGINT % 4098 + 1 AS k
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS n FROM range(32) x(i))
), f AS (
  SELECT 0 AS step, NULL::BIGINT AS slot, [false for x in range(4099)] AS used
  UNION ALL
  SELECT step + 1, c, list_concat(used[:c], [true], used[c + 2:])
  FROM (SELECT step, used, list_filter([(o + j * k) % 4099 for j in range(4099)], lambda p: NOT used[p + 1])[1] AS c
        FROM f JOIN s ON s.i = f.step % 32 WHERE step < 4099)
), t AS (SELECT slot, (step - 1) % 32 AS shard FROM f WHERE step > 0),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % 4099 AS slot FROM documents)
SELECT doc_id, slot, shard::BIGINT AS shard, 'shard-' || lpad(shard::VARCHAR, 5, '0') AS shard_name FROM d JOIN t USING (slot)
"""
