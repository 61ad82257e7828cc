"""Tables written to the folder that driver and executors share, so that loops neither recompute nor lose their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_place(spark: SparkSession, tag: str) -> str:
    """A path of its own under ``spark.checkpoint.dir``; only a local master may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


class Written:
    """A DataFrame written as Parquet to a shared place and read again; the files go with the application."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        path = shared_place(spark, tag)
        jvm = spark.sparkContext._jvm
        self._place = jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        df.write.parquet(path)
        self._files.deleteOnExit(self._place)
        self.df = spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Removes the files; only for tables that no pending plan reads."""
        self._files.delete(self._place, True)
