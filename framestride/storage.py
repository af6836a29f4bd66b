"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="framestride-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Up to so many rows a side is broadcast; above, the join shuffles.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows of a saved table) to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    Results read these tables, so they stay while the application runs and are removed
    when it ends; ``clear`` removes them earlier.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._leave)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str | None = None, group_rows: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back.

        ``group_rows``: rows of a row group, for rows of megabytes. A writer and a reader hold a
        whole group at once, and Parquet looks at sizes only after 100 rows.
        """
        self._n += 1
        where = self.path(name or f"t{self._n}")
        limits = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows, "parquet.page.size.row.check.min": 1}
        df.write.option("compression", "zstd").options(**limits).parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a saved table that nothing reads any longer."""
        self.remove(df._scratch_path)

    def clear(self) -> None:
        """Remove all that was written here, once nothing reads it any longer."""
        atexit.unregister(self._leave)
        self.remove(self.root)

    def remove(self, where: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def _leave(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.remove(self.root)
        except Exception:  # noqa: BLE001, S110 - the session has gone before, and its tables stay
            pass
