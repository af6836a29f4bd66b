"""Order over many tasks equals windows over whole keys."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framestride.operators import ordered
from framestride.storage import Scratch


@pytest.fixture
def rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 300), i, rng.randint(0, 3)) for i in range(3000)]
    return spark.createDataFrame(data, "video string, ts int, id int, v int").repartition(7)


def test_numbers_within_and_without_keys(spark, rows):
    scratch = Scratch(spark, "t")
    got = ordered.numbered(rows, [F.col("ts"), F.col("id")], scratch, ["video"], total="n")
    w = W.partitionBy("video").orderBy("ts", "id")
    want = rows.select("video", "id", (F.row_number().over(w) - 1).alias("idx"), F.count(F.lit(1)).over(W.partitionBy("video")).alias("n"))
    assert sorted(map(repr, got.select("video", "id", F.col("idx").cast("int"), "n").collect())) == sorted(map(repr, want.collect()))
    flat = ordered.numbered(rows, [F.desc("ts"), F.col("id")], scratch).orderBy("idx").collect()
    assert [r["idx"] for r in flat] == list(range(3000)) and [r["id"] for r in flat] == [r["id"] for r in rows.orderBy(F.desc("ts"), "id").collect()]
    assert ordered.numbered(rows.limit(0), [F.col("ts")], scratch, ["video"]).count() == 0


@pytest.mark.parametrize(("size", "halo"), [(64, 5), (3, 5), (1, 2), (5000, 8)])
def test_neighbours_across_stretches(spark, rows, size, halo):
    seq = ordered.numbered(rows, [F.col("ts"), F.col("id")], Scratch(spark, "t"), ["video"])
    wide, far = W.partitionBy("video").orderBy("idx"), W.partitionBy("video", "_stretch").orderBy("idx")
    cols = lambda w: [F.lag("v", 1).over(w).alias("a"), F.lead("v", 2).over(w).alias("b"), F.max("v").over(w.rowsBetween(-2, 2)).alias("c")]
    want = seq.select("video", "idx", *cols(wide)).collect()
    got = ordered.own_rows(ordered.stretched(seq, halo, size).select("video", "idx", *cols(far), "_mine", "_stretch")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    run = ordered.running_sum(seq, "v", "s", "video", size=size).select("video", "idx", "s").collect()
    assert sorted(map(repr, run)) == sorted(map(repr, seq.select("video", "idx", F.sum("v").over(wide).alias("s")).collect()))
