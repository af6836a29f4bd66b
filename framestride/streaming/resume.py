"""Streams of frame metrics: files as they arrive, upserted once for each key.

The checkpoint remembers which files were read and each batch writes whole new
table versions, so a batch that runs twice leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framestride.operators.relational import missing


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files under a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: a partial maximum for each task, then one for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upsert_stream(stream: DataFrame, where: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keep a table with the latest row of each key under ``where/v<batch>``; the newest version is the table.

    A version is written whole before the one it was made from goes away.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, order)
        old = read_table(spark, where, before=number)
        out = new if old is None else missing(old, new, keys).unionByName(new)
        out.write.mode("overwrite").parquet(f"{where}/v{number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, where: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (of those before a batch), or None."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))
    done = [n for n in names if (before is None or int(n[1:]) < before) and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{where}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{where}/{done[-1]}") if done else None


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Frames and mean value of each window and key, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("frames"), F.avg("value").alias("mean"))
