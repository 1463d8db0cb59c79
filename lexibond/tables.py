"""Tables in the folder that the cluster shares, and joins that don't gather a frequent key in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir. Where it is unset, a local session gets a temporary one;
    on a cluster that would be one machine's folder, so it is an error."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lexibond-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


_LARGE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Table:
    """A table written to the shared folder and read again: its lineage is the files, which outlive any executor.

    The shuffles of the write end with it. What isn't dropped before is deleted when the driver ends. large: rows of megabytes,
    in row groups of a few, so that no task holds many and a file can be shared out."""

    def __init__(self, df: DataFrame, tag: str, large: bool = False) -> None:
        self.spark = df.sparkSession
        self.path = f"{work_dir(self.spark)}/lexibond-{tag}-{uuid.uuid4().hex}"
        path, files = self._files()
        files.deleteOnExit(path)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**(_LARGE if large else {})).parquet(self.path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Deletes the files: only when every table made from them has been written."""
        path, files = self._files()
        files.delete(path, True)


HOT = 256


def lookup(rows: DataFrame, key: str, values: DataFrame, hot: list | None = None) -> DataFrame:
    """rows (a written table) with the other columns of `values`, which has one row for a key, as a left join on `key`.

    Keys with 1/HOT of the rows or more, so at most HOT of them, are joined by a broadcast of their values, not in a task
    of their own. hot: those keys, if they are known."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(values, key, "left")
    often = F.col(key).isin(hot)
    cold = rows.where(~often | F.col(key).isNull()).join(values, key, "left")
    return cold.unionByName(rows.where(often).join(F.broadcast(values.where(often)), key, "left"))


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys with 1/HOT of the rows or more: HOT numbers at most."""
    total = rows.count()
    if not total:
        return []
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where((F.col("n") * HOT >= total) & (F.col("n") > 1)).select(key).collect()]
